"""Token counts with a shortcut for whole tokens.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges each by itself.
Before any text is read, every string of the vocabulary is encoded alone; those
that come out as one token are proven to be one token wherever they are a
pre-token. Pre-tokens of this kind are counted as they are; the merges run only
for the rest, once for each distinct one that a worker meets.

Pre-tokens are cut by the `regex` module. Its character classes are compared with
the tokenizer's for every code point; texts with a character on which the two
differ go through the tokenizer whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, map_batches, raw

#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct merged pre-tokens that a worker remembers, and characters of one at most; when full it starts anew.
MEMO, LONG = 400_000, 64


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Shortcut:
    """What is proven about a tokenizer: its file, whole tokens, odd characters and special strings."""

    spec: str
    whole: list[str]
    odd: list[str]
    special: list[str]


def prove(path: str) -> Shortcut:
    """Read a tokenizer file and find what the shortcut may rest on."""
    import regex
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        spec = f.read()
    parsed = json.loads(spec)
    pre = parsed["pre_tokenizer"]
    if parsed["normalizer"] or parsed["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("not a plain byte-level BPE tokenizer")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in parsed["added_tokens"]):
        raise ValueError("special tokens that take in what stands beside them")
    tokenizer = Tokenizer.from_str(spec)
    letter_byte = {c: b for b, c in byte_letters().items()}
    special = [a["content"] for a in parsed["added_tokens"]]
    strings = []
    for token in parsed["model"]["vocab"]:
        try:
            strings.append(bytes(letter_byte[c] for c in token).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    strings = [s for s in strings if not any(x in s for x in special)]
    whole = [s for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1]

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    kinds = {"a": regex.compile(r"\p{L}"), "1": regex.compile(r"\p{N}"), " ": regex.compile(r"\s")}
    groups: dict[str, list[str]] = {"a": [], "1": [], " ": [], "!": []}
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            groups[next((k for k, r in kinds.items() if r.match(c)), "!")].append(c)
    odd = [c for k, group in groups.items() if len(cut(k + "".join(group))) > 1 for c in group if len(cut(k + c)) > 1]
    return Shortcut(spec, whole, odd, special)


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, shortcut: Shortcut):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(shortcut.spec)
        self.model = self.tokenizer.model
        self.find = regex.compile(PATTERN).findall
        self.odd = regex.compile("[" + "".join(map(regex.escape, shortcut.odd)) + "]").search if shortcut.odd else lambda text: None
        self.odd_is_wide = all(ord(c) > 0xFF for c in shortcut.odd)
        self.special = regex.compile("|".join(map(regex.escape, shortcut.special))) if shortcut.special else None
        self.letters = byte_letters()
        self.whole = dict.fromkeys(shortcut.whole, 1)
        self.memo: dict[str, int] = {}

    def merged(self, pre_token: str) -> int:
        n = self.memo.get(pre_token)
        if n is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            n = len(self.model.tokenize("".join(map(self.letters.__getitem__, pre_token.encode()))))
            if len(pre_token) <= LONG:
                self.memo[pre_token] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        found = self.find(text)
        rest = [p for p in found if p not in self.whole]
        return len(found) - len(rest) + sum(map(self.merged, rest))

    def count(self, text: str) -> int:
        if not text.isascii():
            try:
                # Most texts are in Latin-1, which is quicker to see than that they have no odd character.
                plain = self.odd_is_wide and bool(text.encode("latin-1"))
            except UnicodeEncodeError:
                plain = False
            if not plain and self.odd(text):
                return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row for each document: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    `path` is the tokenizer's file. Special strings inside texts are single tokens, as
    the tokenizer takes them by default. Null and empty texts have no bytes and no
    tokens. Repeated rows give a row each; an empty table gives none.
    """
    shortcut = Sent(docs.sparkSession, prove(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shortcut.value)
        for batch in batches:
            texts = raw(batch.column(1))
            n = [counter.count(x.decode("utf-8", "replace")) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) if x else 0 for x in texts], pa.int64()), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
