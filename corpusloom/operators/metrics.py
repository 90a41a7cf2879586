"""Corpus BLEU and chrF++ as two-phase aggregates: n-gram counts per row, sums over the corpus, then the formula."""

from __future__ import annotations

import re
import string
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

BLEU_ORDER, CHAR_ORDER, WORD_ORDER, BETA = 4, 6, 2, 2.0


def _overlap(a, b, n):
    grams = lambda x: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    p, r = grams(a), grams(b)
    return sum((p & r).values()), sum(p.values()), sum(r.values())


def _words(text: str) -> list[str]:
    """Words with one leading or trailing punctuation mark split off."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def row_counts(prediction: str, reference: str) -> list[int]:
    p, r = prediction.split(), reference.split()
    out = [len(p), len(r)]
    for n in range(1, BLEU_ORDER + 1):
        out += _overlap(p, r, n)[:2]
    a, b = (re.sub(r"\s", "", x) for x in (prediction, reference))
    for n in range(1, CHAR_ORDER + 1):
        out += _overlap(a, b, n)
    a, b = _words(prediction), _words(reference)
    for n in range(1, WORD_ORDER + 1):
        out += _overlap(a, b, n)
    return out


@F.pandas_udf(ArrayType(LongType()))
def _counts(p: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([row_counts(a or "", b or "") for a, b in zip(p, r, strict=True)])


WIDTH = 2 + 2 * BLEU_ORDER + 3 * (CHAR_ORDER + WORD_ORDER)


def corpus_scores(rows: DataFrame, prediction="prediction", reference="reference", by: tuple[str, ...] = ()) -> DataFrame:
    """bleu and chrf (0 to 100) of each group."""
    counted = rows.select(*by, _counts(F.col(prediction), F.col(reference)).alias("c"))
    s = counted.groupBy(*by).agg(F.count("*").alias("n_rows"), *(F.sum(F.get("c", F.lit(i))).alias(f"s{i}") for i in range(WIDTH)))
    logs, zeros, whole, some = F.lit(0.0), F.lit(0), F.lit(True), F.lit(0)
    for n in range(BLEU_ORDER):
        hit, all_ = F.col(f"s{2 + 2 * n}"), F.col(f"s{3 + 2 * n}")
        # an order without matches counts 1/2, the next such 1/4 and so on
        zeros = zeros + F.when(hit == 0, 1).otherwise(0)
        logs = logs + F.ln(F.when(hit > 0, hit.cast("double")).otherwise(F.pow(F.lit(0.5), zeros)) / F.greatest(all_, F.lit(1)))
        whole, some = whole & (all_ > 0), some + hit
    brevity = F.when(F.col("s0") < F.col("s1"), F.exp(1 - F.col("s1") / F.greatest(F.col("s0"), F.lit(1)))).otherwise(1.0)
    bleu = F.when(whole & (some > 0), 100 * brevity * F.exp(logs / BLEU_ORDER)).otherwise(0.0)
    scores, present = F.lit(0.0), F.lit(0)
    for n in range(CHAR_ORDER + WORD_ORDER):
        hit, p, r = (F.col(f"s{2 + 2 * BLEU_ORDER + 3 * n + k}") for k in range(3))
        both = (p > 0) & (r > 0)
        prec, rec = hit / F.greatest(p, F.lit(1)), hit / F.greatest(r, F.lit(1))
        f = F.when(hit > 0, (1 + BETA**2) * prec * rec / F.greatest(BETA**2 * prec + rec, F.lit(1e-300))).otherwise(0.0)
        scores, present = scores + F.when(both, f).otherwise(0.0), present + F.when(both, 1).otherwise(0)
    chrf = F.when(present > 0, 100 * scores / present).otherwise(0.0)
    return s.select(*by, "n_rows", bleu.alias("bleu"), chrf.alias("chrf"))
