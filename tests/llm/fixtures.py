"""A small documents table with nulls, empty and long texts, copies, near copies and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, bucket int, kind int, rep long, _keep_id long"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    made = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(24)]
    passage = " ".join(word() for _ in range(40))
    out = [*made, made[0], made[0].upper(), made[1], made[2] + " tail", made[3] + " " + passage, "x " + passage + " " + made[4], passage]
    near = made[5].split()
    near[7] = "changed"
    out += [" ".join(near), None, "", "   ", "one", "two words", "Ünï çödé ß 日本語 🎉 <|endoftext|> end", "a" * 700, "ab " * 400, "\x00 nul \x00", "12 34\n\n\t5", " ".join(word() for _ in range(9000))]
    return out


def rows():
    langs, sources = ["en", "de", None], ["s1", "s2", None, "s3"]
    out = [(i, t, langs[i % 3], sources[i % 4] if i % 5 else "s1", len(t or ""), True, 1, 2, 3, 4, 5) for i, t in enumerate(texts())]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
