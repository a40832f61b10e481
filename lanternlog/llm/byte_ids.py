"""Token ids of a byte-level vocabulary by its library, each different stretch of text once per worker."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lanternlog.llm.common import offsets_of
from lanternlog.llm.known import Known, Runs, cut_at_spaces, text_bytes


class ByteIds(Known):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.ids = Runs(np.uint32)

    def learn(self, parts: list[bytes]) -> None:
        for i in range(0, len(parts), 20_000):
            made = self.library.encode_batch_fast([p.decode() for p in parts[i : i + 20_000]], add_special_tokens=False)
            ids = [np.array(m.ids, np.uint32) for m in made]
            self.ids.extend(np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (each followed by ``end``), and where each text's ids begin."""
        data, bounds = text_bytes(column)
        starts, ends, counts = cut_at_spaces(data, bounds, self.special)
        at = self.number(data, starts, ends)
        begins = offsets_of(self.ids.lengths(at))[offsets_of(counts)]
        ids = self.ids.take(at)
        if end is None:
            return ids, begins
        out = np.full(len(ids) + len(counts), end, np.uint32)
        mine = np.ones(len(out), bool)
        begins = begins + np.arange(len(begins))
        mine[begins[1:] - 1] = False
        out[mine] = ids
        return out, begins


@lru_cache(2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)
