"""Token counts of byte-level BPE by rank-synchronous merging of arrays.

Texts are cut into pre-tokens; the distinct ones of a batch that have not been seen lie behind each other in one array of symbols. In each
round every sequence applies its lowest-ranked pair, at all its places at once, until no sequence has a pair left; the surviving symbols are
its tokens. The merges of the vocabulary file are all that is used of it: no tokenizer library takes part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .scratch import result

#: Cuts text before any merge. A fixed value: the pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers of the ``regex`` module that Unicode 16, by which such vocabularies are applied, has not assigned. Fixed values.
LATER = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959"
    "\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191"
    "\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de"
    "\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
LIMIT = 1024
#: Characters of one text that are cut at once; pre-tokens that are held together, and those whose counts a worker remembers.
PIECE, HELD, REMEMBERED = 1 << 20, 1 << 19, 1 << 19
NO_PAIR, RECUT = np.iinfo(np.int64).max, -(1 << 40)

_WORDS = regex.compile(PATTERN)
_WORDS_LATER = regex.compile("(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{LATER}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{LATER}]]+"))
_LATER = regex.compile(f"[{LATER}]")
_SAFE_CUT = regex.compile(r"(?<=\S)\s")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(others)) for b in range(256)]


class Merges:
    """The pairs of a byte-level BPE file as arrays, and its special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        cut = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special strings that take neighbouring characters are not handled")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.n = len(vocab)
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols survive of each sequence; 0 of an empty one."""
        size = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = size.copy()
        symbol = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), size)
        if not len(symbol):
            return out
        pair = np.full(len(symbol), NO_PAIR)  # the rank of a symbol with its next; none at the end of a sequence
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        pair[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while True:
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            length = np.diff(np.append(first, len(owner)))
            low = np.minimum.reduceat(pair, first)
            done = low == NO_PAIR
            if done.any():
                out[owner[first[done]]] = length[done]
                keep = np.repeat(~done, length)
                symbol, owner, pair, low, length = symbol[keep], owner[keep], pair[keep], low[~done], length[~done]
                if not len(symbol):
                    return out
            hit = np.flatnonzero(pair == np.repeat(low, length))
            # of pairs that overlap (one symbol repeated) every second one counts, from the left
            start = np.concatenate(([True], np.diff(hit) != 1))
            run = hit[np.flatnonzero(start)[np.cumsum(start) - 1]]
            hit = hit[(hit - run) % 2 == 0]
            symbol[hit] = self.made[pair[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            pair[hit] = pair[hit + 1]  # what follows the second symbol is next now, if anything
            at = np.cumsum(keep)[hit] - 1
            symbol, owner, pair = symbol[keep], owner[keep], pair[keep]
            change = np.unique(np.concatenate((at, at[at > 0] - 1)))
            change = change[(change + 1 < len(owner))]
            change = change[owner[change] == owner[change + 1]]
            pair[change] = self.rank(symbol[change], symbol[change + 1])


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=4)
def _known(path: str) -> dict[str, int]:
    return {}


def cuts(text: str, pattern=_WORDS) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists of bounded size: a long text is cut where white space follows something else, as no pre-token spans that."""
    a = 0
    while a < len(text):
        found = _SAFE_CUT.search(text, a + PIECE) if len(text) - a > PIECE else None
        b = found.start() if found else len(text)
        yield pattern.findall(text, a, b)
        a = b


def _learn(words: set[str], path: str) -> None:
    """Remember the tokens of pre-tokens; one with characters of ``LATER`` was cut wrongly and weighs less than nothing."""
    fresh = list(words)
    counts = merges(path).count([w.encode() for w in fresh]).tolist()
    _known(path).update((w, RECUT if not w.isascii() and _LATER.search(w) else n) for w, n in zip(fresh, counts))


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text; special strings are one token each. Pre-tokens of many texts are merged together, so arrays are long."""
    table, known = merges(path), _known(path)
    parts = [table.special.split(t) if table.special else [t] for t in texts]
    out = np.array([len(p) - 1 for p in parts], np.int64)
    held: list[tuple[int, list[str]]] = []
    size, wrong = 0, set()

    def flush() -> None:
        for i, words in held:
            total = sum(map(known.__getitem__, words))
            out[i] += total
            if total < 0:
                wrong.add(i)
        held.clear()

    new: set[str] = set()
    for i, words in ((i, w) for i, p in enumerate(parts) for w in chain.from_iterable(map(cuts, p))):
        new.update(w for w in words if w not in known)
        held.append((i, words))
        size += len(words)
        if size >= HELD:
            _learn(new, path)
            flush()
            new, size = set(), 0
            if len(known) > REMEMBERED:
                known.clear()
    _learn(new, path)
    flush()
    if len(known) > REMEMBERED:
        known.clear()
    for i in wrong:
        out[i] = len(parts[i]) - 1
        for words in chain.from_iterable(cuts(p, _WORDS_LATER) for p in parts[i]):
            one = list(set(words))
            n = dict(zip(one, table.count([w.encode() for w in one]).tolist()))
            out[i] += sum(map(n.__getitem__, words))
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens above ``limit``).

    ``path``: a byte-level BPE file that every executor has. Null and empty texts have 0 bytes and tokens; special strings
    inside texts are one token each; long texts are counted whole, in pieces; every row counts for itself, so repeated rows and null ids
    give rows of their own; an empty table gives none. Columns other than doc_id and text are not used.
    """

    def run(batches):
        for whole in batches:
            for rb in K.text_slices(whole):
                text = pc.fill_null(rb.column("text"), "")
                n = count_texts(text.to_pylist(), path)
                yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return result(spark, "op13", lambda: count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path))
