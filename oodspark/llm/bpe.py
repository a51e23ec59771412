"""Byte-pair encoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges produce.  It is compiled merge by
merge.  For a merge of u and v into w, let q be the state that u leads to: q is split into a copy without the arc v,
to which every arc u now leads, and each state with an arc u gets an arc w that leads where v leads from q.  All arcs
with one label lead to one state, so a state is named by the token that leads to it, and the whole automaton is the table
of splits (which arc a state lost, and when) beside the parts of each token.  A word is encoded left to right: every
prefix has one accepted segmentation, found by looking up arcs from the states of shorter prefixes.  Decoding emits arc
labels.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a generation of those whose encodings a task remembers, and rows encoded at a time: they bound a task's memory.
REMEMBERED, ROWS = 100_000, 256
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is printable in Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Automaton:
    """Compiled merges.  Tokens are integers, and so is the state that a token leads to; START has an arc for each single byte."""

    START, NEVER = -1, -2

    def __init__(self, merges: list, vocab: dict[str, int]):
        size, byte = max(vocab.values(), default=-1) + 1, {c: b for b, c in enumerate(byte_symbols())}
        self.label: list[str | None] = [None] * size
        #: The merge that made a token: -1 for single bytes, NEVER for tokens that no text gives.  Its two parts.
        self.born, self.left, self.right = (array("i", [x]) * size for x in (self.NEVER, -1, -1))
        #: State and lost arc -> the merge that took it away.
        self.splits: dict[int, int] = {}
        text: dict[int, tuple[str, bool]] = {}
        for s, i in vocab.items():
            self.label[i] = s
            if len(s) == 1 or len(s) == 1 + len(END) and s.endswith(END):
                text[i] = (s[0], len(s) > 1)
                self.born[i] = -1
        for time, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in text:
                raise ValueError(f"two merges make {a + b!r}")
            text[w] = (text[u][0] + text[v][0], text[v][1])
            self.gadget(time, u, v, w)
        # the bytes of the tokens as a tree: node and byte -> node, and the token that ends at a node inside a word or at its end
        self.tree: dict[int, int] = {}
        self.middle, self.final = [-1], [-1]
        for i, (s, last) in text.items():
            if self.born[i] != self.NEVER:
                node = 0
                for c in s:
                    arc = node << 8 | byte[c]
                    node = self.tree.get(arc)
                    if node is None:
                        node = self.tree[arc] = len(self.middle)
                        self.middle.append(-1)
                        self.final.append(-1)
                (self.final if last else self.middle)[node] = i

        self.arcs = Recent(self.accepts, REMEMBERED)

    def gadget(self, time: int, u: int, v: int, w: int) -> None:
        """The state of u loses its arc v, and w, made of them, goes from where u came to where v leads."""
        if self.NEVER in (self.born[u], self.born[v]) or not self.accepts(u << 32 | v):
            return  # the pair never meets, so the merge makes nothing
        self.splits[u << 32 | v] = time
        self.left[w], self.right[w], self.born[w] = u, v, time

    def accepts(self, arc: int) -> bool:
        """Has a state an arc for a token?  arc is both in one number.

        Back in time: before the younger of the two was made, its place was taken by its part on the side where they
        meet, and an arc that was lost between those tokens then is lost for ever.
        """
        u, v, before = arc >> 32, arc & 0xFFFFFFFF, 1 << 62
        while u != self.START:
            if self.splits.get(u << 32 | v, before) < before:
                return False
            if self.born[u] > self.born[v]:
                before, u = self.born[u], self.right[u]
            elif self.born[v] >= 0:
                before, v = self.born[v] + 1, self.left[v]  # the merge that made it took its arc from the state it split
            else:
                break
        return True

    def encode(self, word: bytes) -> list[int]:
        """Tokens of a word; bytes outside the vocabulary give no token."""
        n, tree, arcs, known = len(word), self.tree.get, self.arcs, self.arcs.young.get
        middle, ends = self.middle, n - 1
        last, back = [self.START] * (n + 1), [-1] * (n + 1)
        for j in range(n):  # last[j], the state of a prefix, is settled: it came from shorter prefixes
            node, state, i = 0, last[j] << 32, j
            while i < n:
                node = tree(node << 8 | word[i])
                if node is None:
                    break
                token = middle[node] if i < ends else self.final[node]
                i += 1
                if token >= 0 and back[i] < 0:
                    there = known(state | token)
                    if arcs(state | token) if there is None else there:
                        last[i], back[i] = token, j
        out, i = [], n
        while i:
            if back[i] >= 0:
                out.append(last[i])
                i = back[i]
            else:
                i -= 1
        return out[::-1]

    def decode(self, ids) -> str:
        """Arc labels, with a space between them."""
        label = self.label
        return " ".join([label[i] for i in ids if 0 <= i < len(label) and label[i] is not None])


class Recent:
    """What was computed of late, by key: two generations of bounded size, so that frequent keys stay and memory doesn't grow."""

    def __init__(self, compute, most: int):
        self.compute, self.most = compute, most
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = found
        return found


class Tokenizer:
    """Special tokens, normalisation and splitting of a vocabulary file around an Automaton."""

    #: The split pattern of the vocabulary file.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: Texts of characters below this code point are split here; the rest by the vocabulary's own splitter, as their letters
    #: and cases depend on the version of Unicode.
    PLAIN_BELOW = 0x180

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer as Library

        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != self.SPLIT:
            raise ValueError("only word-end BPE vocabularies with the known split pattern are compiled")
        self.automaton = Automaton([m.split(" ") if isinstance(m, str) else m for m in model["merges"]], model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.automaton.label += [None] * (i + 1 - len(self.automaton.label))
            self.automaton.label[i] = word
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        spaces = r" \t-\r\x85\xa0"
        letters, digits = self.category("L"), self.category("N")
        self.words = re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{digits}]|[^{spaces}{letters}{digits}]+")
        self.odd = re.compile(f"[^\\x00-\\u{self.PLAIN_BELOW - 1:04x}]")
        self.byte = {c: b for b, c in enumerate(byte_symbols())}
        bare = {"version": spec["version"], "added_tokens": [], "normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"], "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.library = Library.from_str(json.dumps(bare))
        self.recent = Recent(lambda word: little(self.automaton.encode(word.encode("utf-8", "replace"))), REMEMBERED)

    def category(self, kind: str) -> str:
        runs = itertools.groupby(range(self.PLAIN_BELOW), key=lambda c: unicodedata.category(chr(c))[0] == kind)
        ends = [(run[0], run[-1]) for inside, run in ((inside, list(run)) for inside, run in runs) if inside]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ends)

    def pieces(self, text: str) -> list[bytes]:
        """Ids of each word of a text without special tokens, as little-endian 32-bit integers."""
        if self.odd.search(text):
            byte = self.byte
            words = [bytes([byte[c] for c in w]).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        else:
            words = self.words.findall(unicodedata.normalize("NFC", text).lower())
        recent, out = self.recent, []
        for w in words:
            out.append(recent.young.get(w) or recent(w))
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as little-endian 32-bit integers.  A null text has none."""
        out: list[bytes] = []
        for part in self.parts.split(text or "") if self.parts else [text or ""]:
            if part in self.special:
                out.append(little([self.special[part]]))
            elif part:
                out += self.pieces(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, dtype="<u4").tolist())


def little(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as f:
        return Tokenizer(json.load(f))


def encoded(docs: DataFrame, path: str, output: str = "digests") -> DataFrame:
    """doc_id, n_tokens and, by output, the digests ids_sha256 and decoded_sha256, or ids, or ids and decoded, of every whole text.

    Null and empty texts have no tokens.  Repeated rows give repeated rows, an empty table an empty result; other
    columns of docs play no part.  Very long texts are encoded whole.  No row moves between tasks.  The vocabulary file is read on the driver and sent to
    the executors, each of which compiles the automaton once: its size is that of the vocabulary, not of the corpus.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())
    kinds = "n_tokens long, " + {"digests": "ids_sha256 string, decoded_sha256 string", "ids": "ids array<int>", "both": "ids array<int>, decoded string"}[output]

    def run(batches):
        tok = compiled(spec)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [tok.encode(t) for t in part.column(1).to_pylist()]
                out = {"doc_id": part.column(0), "n_tokens": pa.array([len(i) // 4 for i in found], pa.int64())}
                if output == "digests":
                    out["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i in found], pa.string())
                    out["decoded_sha256"] = pa.array([hashlib.sha256(tok.decode(i).encode("utf-8")).hexdigest() for i in found], pa.string())
                else:
                    ends = np.cumsum([0, *(len(i) // 4 for i in found)], dtype=np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4").astype(np.int32)))
                    if output == "both":
                        out["decoded"] = pa.array([tok.decode(i) for i in found], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {kinds}")


_compiled: dict[int, Tokenizer] = {}


def compiled(spec) -> Tokenizer:
    """The tokenizer of a broadcast vocabulary, one for each Python worker."""
    key = hash(spec.value)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Tokenizer(json.loads(spec.value))
    return _compiled[key]


def decoded(ids: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """ids with a column decoded: the arc labels of each array of ids.  Unknown and null ids emit nothing; a null array decodes to null."""
    spec = ids.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    @F.pandas_udf("string")
    def labels(x: pd.Series) -> pd.Series:
        decode = compiled(spec).automaton.decode
        return x.map(lambda a: None if a is None else decode(a))

    return ids.withColumn("decoded", labels(F.col(column)))


def op3_bpe_encode(spark, sf_dir):
    import public_tokenizers

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_bpe_encode": op3_bpe_encode}
ORACLES: dict[str, str] = {}
