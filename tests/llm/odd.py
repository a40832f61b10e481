"""Rows that an operator must survive: nulls, empty and long texts, repeats, and columns named like its own."""

from __future__ import annotations

import random

CLASHING = "fp fingerprint component_id n_tokens start ids score lang_pred part copy rep node label_ sequence_id log_weight".split()


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    words = "the of and house garden river quickly <|endoftext|> <|startoftext|> don't naïve 12 3.5 ½ 日本語 🙂 ΣΑΣ".split()
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    out: list[tuple[int | None, str | None]] = list(enumerate(prose))
    out += [
        (100, None), (101, ""), (102, " "), (103, "\n\t  \n"), (104, "!!! ???"), (105, prose[0]), (106, prose[0] + " end"),
        (107, "long " * 60_000), (108, "x" * 200_000), (109, "a\u0085b c  d  e\x1cf"), (110, " lead and trail "),
        (111, "İSTANBUL É é ﬁ"), (112, "don't we'LL I'M"), (0, prose[0]), (0, "another text"), (None, prose[1]), (None, None),
    ]
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
    langs = [None, "en", "fr"]
    data = [(i, t, langs[n % 3], None, n, *("x" for _ in CLASHING)) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema)
