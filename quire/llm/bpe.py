"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be joined, so a text may be cut there and
its fragments encoded apart; their ids, one after the other, are those of the whole text. The splitter that runs
before the merges looks at neighbouring characters, so a cut is made only where it can't notice: behind a
character that isn't white space, and not before an apostrophe. Fragments recur, and are encoded once per worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import ship, tidy

#: Bytes of fragments and their ids that a worker remembers during a task; others are encoded each time they occur.
REMEMBERED = 24_000_000
#: What an entry takes besides its characters and ids.
_ENTRY = 170
#: Fragments of more characters are cut at every other certain boundary too.
LONG = 64
_LOADED: dict[str, Codec] = {}
#: The characters that byte-level vocabularies print for themselves.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Endings that the byte-level splitter keeps in one piece.
_ENDINGS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
_OTHER_SPACE = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


class Codec(dict):
    """Maps a fragment to the bytes of its ids (little-endian, 32 bits); missing ones are encoded."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.room = REMEMBERED
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        rest = [b for b in range(256) if b not in set(_PRINTED)]
        byte_of = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        raw = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.pairs = np.zeros((256, 256), bool)
        for t in raw:
            for a, b in zip(t, t[1:], strict=False):
                self.pairs[a, b] = True
        self.token = [b""] * (1 + max([*raw.values(), *self.special.values()]))
        for t, i in raw.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.decimal = [str(i) for i in range(len(self.token))]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        plain = not any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word"))
        pre = spec.get("pre_tokenizer") or {}
        #: Cuts are safe for the plain byte-level splitter only; any other set-up encodes whole texts.
        self.cuts = plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and all(self.pairs[a, b] for e in _ENDINGS for a, b in zip(e.encode(), e.encode()[1:], strict=False))
        #: Blanks and newlines follow nothing inside a token but white space: a cut before them is certain.
        self.spaced = self.cuts and self._only_spaces(32) and self._only_spaces(10)
        by_rank = all(vocab.get(a + b) == len(_PRINTED) + len(rest) + i for i, (a, b) in enumerate(merges)) and sorted(raw.values()) == list(range(len(raw)))
        #: The rank encoder gives the same ids sooner, where ids follow the order of the merges.
        self.ranks = tiktoken.Encoding("fragments", pat_str=_pattern(), mergeable_ranks=raw, special_tokens={}) if self.cuts and by_rank else None

    def _only_spaces(self, second: int) -> bool:
        """Whether this byte stands inside no token but those that are white space altogether."""
        return all(t.decode("utf-8", "replace").isspace() for t in self.token if second in t[1:])

    def _encode(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.ranks else self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        """Gives the memory of the fragments back."""
        self.clear()
        self.room = REMEMBERED

    def __missing__(self, fragment: str) -> bytes:
        text = fragment if fragment[:1] == "\n" else " " + fragment
        ids = [i for part in self.forced(text) for i in self._encode(part)] if len(text) > LONG else self._encode(text)
        out = array("I", ids).tobytes()
        if self.room > 0:
            self[fragment] = out
            self.room -= _ENTRY + len(fragment) + len(out)
        return out

    def forced(self, text: str) -> list[str]:
        """The text cut at every certain boundary."""
        if not self.cuts or len(text) < 2:
            return [text]
        data = np.frombuffer(text.encode(), np.uint8)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        at = first[1:]
        free = ~self.pairs[data[at - 1], data[at]] & (data[at] != 39)
        cut = np.flatnonzero(free) + 1
        cut = [int(c) for c in cut if not text[c - 1].isspace() and not _OTHER_SPACE.match(text[c - 1])]
        return [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, special tokens' strings included, as the tokenizers library gives them."""
        if not self.cuts:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return np.concatenate([np.array([self.special[p]], "<u4") if p in self.special else self._plain(p) for p in parts])
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if not self.spaced or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER_SPACE.search(text):
            return np.array([i for part in self.forced(text) for i in self._encode(part)], "<u4")
        # every white space is a lone blank or newline, so each stands right before a fragment
        head, *rest = text.replace("\n", " \n").split(" ")
        front = np.array(self._encode(head), "<u4").tobytes() if head else b""
        return np.frombuffer(front + b"".join(map(self.__getitem__, rest)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def codec(path: str) -> Codec:
    """This process's codec for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids and decoded. A null text
    counts as empty (no ids, hashes of the empty string); a null id is kept; repeated rows give repeated rows; an
    empty table gives none; other columns are dropped, whatever their names.
    """
    ship(docs.sparkSession)
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    if with_ids:
        fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]
    schema = pa.schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            n, hashes, back, lists, texts = [], [], [], [], []
            for t in b.column(1):
                ids = c.ids(t.as_py() or "")
                n.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                decoded = c.decode(ids)
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
                    texts.append(decoded)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        c.forget()

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(tidy(work), ddl)
