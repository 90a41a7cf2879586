"""Subword codecs over a SentencePiece model file, loaded once a worker; the path is a parameter that executors can read."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Codec:
    """Ids of a text as a translation model reads them: a language mark of the prefix, pieces, the end.

    `vocab` lists the pieces by id; without it they are the model's own. Special pieces in a text stand for themselves,
    unknown pieces for `unk`."""

    def __init__(self, path: str, prefix: str = "", vocab: tuple[str, ...] | None = None, eos: str = "</s>", unk: str = "<unk>", pad: str = "<pad>"):
        self.path, self.prefix, self.vocab, self.eos, self.unk = path, prefix, vocab, eos, unk
        self.special = (eos, unk, pad)

    def _tables(self):
        return _tables(self.path, self.vocab)

    def pieces(self, text: str) -> list[str]:
        return _model(self.path).encode_as_pieces(text)

    def encode(self, text: str) -> list[int]:
        _, ids = self._tables()
        unk = ids[self.unk]
        out = []
        for part in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", self.prefix + text):
            if part in self.special:
                out.append(ids.get(part, unk))
            elif part.strip():
                mark = regex.match(r">>.*?<<", part, regex.S)
                if mark:
                    out.append(ids.get(mark[0], unk))
                out += [ids.get(p, unk) for p in self.pieces(part[mark.end() :] if mark else part)]
        return [*out, ids[self.eos]]

    def decode(self, ids) -> str:
        names, numbers = self._tables()
        dropped = {numbers.get(s) for s in self.special}
        return "".join(names[i] if 0 <= i < len(names) else self.unk for i in ids if i not in dropped).replace("▁", " ").strip()

    def encoded(self, c: Column) -> Column:
        """array<int>; null for null."""
        return F.pandas_udf(_each(self.encode), "array<int>")(c)

    def decoded(self, c: Column) -> Column:
        return F.pandas_udf(_each(self.decode), "string")(c)

    def length(self, c: Column) -> Column:
        """The number of ids, without sending them; null for null."""
        return F.pandas_udf(_each(lambda x: len(self.encode(x)), "Int32"), "int")(c)


def _each(f, dtype=None):
    def run(s: pd.Series) -> pd.Series:
        out = s.map(f, na_action="ignore")
        return out.astype(dtype) if dtype else out

    return run


@lru_cache(4)
def _tables(path: str, vocab: tuple[str, ...] | None):
    m = _model(path)
    names = list(vocab) if vocab else [m.id_to_piece(i) for i in range(m.get_piece_size())]
    ids: dict[str, int] = {}
    for i, n in enumerate(names):
        ids.setdefault(n, i)
    return names, ids
