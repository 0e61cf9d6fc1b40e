"""A small corpus with the hard cases: nulls, empty and long texts, copies, near copies, shared passages, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long, host string, token string, chunk int, id string, score string, bin_id string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = prose(rng, 150).split()
    passage = prose(rng, 60)
    out = [None, "", "   \n\t", "one", "Two words", "Ünïcode ÄÖ\x0bvertical\x0ctab 日本 😀", "a b c d e", " ".join(["same"] * 80), "line x y\n" * 12]
    out += [" ".join(base)] * 3  # copies
    for k in range(12):  # near copies of one another
        w = list(base)
        w[(k * 11) % 150] = f"changed{k}"
        out.append(" ".join(w))
    half = base[:75] + prose(rng, 75).split()
    out.append(" ".join(half))
    for _ in range(6):
        out.append(prose(rng, 40) + "\n" + passage + " " + prose(rng, 30))
    out += [prose(rng, rng.randint(5, 120)) for _ in range(25)]
    out.append(prose(rng, 6000))  # long
    out.append("Symbols### " * 30)
    out.append("SHOUT!! " * 20 + prose(rng, 20))
    return out


def rows(seed=1):
    found = [(i * 3 + 1, t, "en", "src0" if i % 3 else None, None if t is None else len(t), "x", i, "h", None, 7, "id", "s", "b") for i, t in enumerate(texts(seed))]
    found.append(found[9])  # a repeated row
    found.append((None, "a text without an id that has quite a few words of its own in it", *found[0][2:]))
    return found


def frame(spark, seed=1, partitions=3):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
