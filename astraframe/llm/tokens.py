"""Token counts: batch encoding in Arrow functions, lengths only.

Texts are encoded in batches that hold about as many bytes each, and long texts are cut first at
boundaries where the pre-tokenizer's pattern always ends a piece: before a space that follows
anything but white space, and before a stop or comma that follows a letter of scripts without
spaces. The parts of a text are counted alone and added up. Special strings must not hold a space.

The vocabulary file is that of ``tokenizers``; its byte-level BPE with ranks is the same vocabulary,
and the rank encoder is several times faster. Texts whose characters all lie in blocks on which the
two pattern engines agree (below U+0250 and common punctuation) take it; all others take
``tokenizers`` itself. Special strings are cut out first, as ``tokenizers`` does by default.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, small_batches, text_slices

#: Bytes encoded at a time, and the length beyond which a text is cut.
BATCH_BYTES = 1 << 20
LONG_CHARS = 1 << 16

_SAFE_CUT = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?= )|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
_OTHER = re.compile("[^\x00-ɏ‐-‧€]")


def parts(text: str, limit: int = LONG_CHARS) -> Iterator[str]:
    """Cut at the first safe boundary after each limit characters; a text without one stays whole."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE_CUT.search(text, start + limit)
        if not cut or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _byte_of() -> dict[str, int]:
    """The visible alphabet of byte-level vocabularies: printable bytes stand for themselves, others from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class Encoder:
    """Encodes as ``tokenizers`` does with add_special_tokens=False, truncation and padding off."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.quick = None
        pre = spec.get("pre_tokenizer") or {}
        plain = (
            spec["model"]["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and not spec["model"].get("ignore_merges")
            and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
        )
        if plain:
            import public_tokenizers

            byte_of = _byte_of()
            ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def slow(self, text: str) -> bool:
        """Whether a text goes to ``tokenizers`` itself."""
        return self.quick is None or not text.isascii() and _OTHER.search(text) is not None

    def ids(self, text: str) -> np.ndarray:
        """Token ids as unsigned 32-bit values."""
        if not text:
            return np.empty(0, np.uint32)
        if self.slow(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.cut is None or not any(s in text for s in self.special):
            return np.frombuffer(self.quick._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)
        return np.concatenate([np.array([self.special[x]], np.uint32) if x in self.special else self.ids(x) for x in self.cut.split(text) if x] or [np.empty(0, np.uint32)])

    def lengths(self, texts: list[str]) -> list[int]:
        """Numbers of ids: one batch call for what goes to ``tokenizers``, and ids that are dropped at once for the rest."""
        whole = [self.slow(t) for t in texts]
        found = iter(self.whole.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False) if any(whole) else ())
        return [len(next(found).ids if w else self.ids(t)) for t, w in zip(texts, whole)]


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give a row
    each; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, limit=BATCH_BYTES):
                texts = part.column(1).to_pylist()
                pieces, owner = [], []
                for i, t in enumerate(texts):
                    for p in parts(t):
                        pieces.append(p)
                        owner.append(i)
                n = np.zeros(len(texts), np.int64)
                np.add.at(n, owner, e.lengths(pieces))
                size = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return picked.mapInArrow(count, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
