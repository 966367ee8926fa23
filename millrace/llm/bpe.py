"""Byte-level BPE through a minimal acyclic transducer lexicon.

The words of all documents are counted and the most frequent ones, at most
``lexicon_size``, are compiled into an automaton that shares suffixes.  Its
edges carry numbers whose sum along a path is the word's index, and the index
points to the word's ids.  The automaton is written to a local file, opened by
memory map, and walked for all distinct words of a chunk in lockstep.  Words
outside it are merged exactly, so the lexicon's size changes speed alone.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import re
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, distinct_ranges, drop_staged, ranges, stage_table, utf8

LEXICON_SIZE = 100_000
CHUNK = 2 << 20
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
# fixed values: code points with the White_Space property
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Model:
    """Vocabulary, merges and added tokens of a byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.byte_id = [vocab[c] for c in symbols]
        self.join: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.join.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.pieces[i] = token.encode()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token, by rank and then from the left."""
        ids = [self.byte_id[b] for b in word]
        join = self.join
        if len(ids) <= 32:
            while len(ids) > 1:
                best, at, to = 1 << 60, -1, 0
                for i in range(len(ids) - 1):
                    got = join.get(ids[i] << 32 | ids[i + 1])
                    if got is not None and got[0] < best:
                        best, at, to = got[0], i, got[1]
                if at < 0:
                    break
                ids[at : at + 2] = [to]
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            got = join.get(ids[i] << 32 | ids[i + 1])
            if got is not None:
                heap.append((got[0], i, ids[i], ids[i + 1], got[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = to, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    got = join.get(ids[left] << 32 | ids[right])
                    if got is not None:
                        heapq.heappush(heap, (got[0], left, ids[left], ids[right], got[1]))
        return [x for x in ids if x >= 0]


class Merger:
    """Merges many short words at once: one merge a word and round, in lockstep."""

    LONGEST = 40

    def __init__(self, model: Model):
        self.model = model
        keys = np.array(list(model.join), np.int64)
        order = np.argsort(keys)
        self.key = keys[order]
        value = np.array(list(model.join.values()), np.int64)[order]
        self.rank, self.to = value[:, 0], value[:, 1]
        self.byte_id = np.array(model.byte_id, np.int64)
        self.slot = np.full(1 << 19, -1, np.int32)  # open addressing over the merges
        todo, at = np.arange(len(keys)), self._hash(self.key)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slot) - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = (left << 32) | right
        at = self._hash(want)
        found = self.slot[at]
        hit = (found >= 0) & (self.key[found] == want)
        more = np.flatnonzero((found >= 0) & ~hit)
        while len(more):
            at[more] = (at[more] + 1) & (len(self.slot) - 1)
            found[more] = self.slot[at[more]]
            hit[more] = (found[more] >= 0) & (self.key[found[more]] == want[more])
            more = more[(found[more] >= 0) & ~hit[more]]
        return np.where(hit, self.rank[found], 1 << 40), np.where(hit, self.to[found], 0)

    def _group(self, data, start, size):
        n = len(start)
        ids = self.byte_id[data[start[:, None] + np.arange(size)]]
        left = np.full(n, size)
        if size == 1:
            return ids, left
        rank, to = self._look(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank, to = rank.reshape(n, -1), to.reshape(n, -1)
        row = np.arange(n)
        done_ids = ids.copy()
        while len(row):
            j = rank.argmin(axis=1)
            k = np.arange(len(row))
            go = rank[k, j] < 1 << 40
            if not go.all():
                done_ids[row[~go]] = ids[~go]
                row, ids, rank, to, j = row[go], ids[go], rank[go], to[go], j[go]
                k = np.arange(len(row))
                if not len(row):
                    break
            ids[k, j] = to[k, j]
            wide = ids.shape[1]
            shift = np.arange(wide)[None, :] > j[:, None]
            ids = np.where(shift, np.concatenate([ids[:, 1:], np.full((len(row), 1), -1)], axis=1), ids)
            shift = shift[:, :-1] | (np.arange(wide - 1)[None, :] == j[:, None])
            rank = np.where(shift, np.concatenate([rank[:, 1:], np.full((len(row), 1), 1 << 40)], axis=1), rank)
            to = np.where(shift, np.concatenate([to[:, 1:], np.zeros((len(row), 1), np.int64)], axis=1), to)
            left[row] -= 1
            for at in (j - 1, j):
                ok = (at >= 0) & (at + 1 < left[row])
                q, at = k[ok], at[ok]
                rank[q, at], to[q, at] = self._look(ids[q, at], ids[q, at + 1])
        return done_ids, left

    def merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's ids start and how many they are."""
        at, n, parts, used = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0
        for size in np.unique(length).tolist():
            rows = np.flatnonzero(length == size)
            if size <= self.LONGEST:
                ids, left = self._group(data, start[rows], size)
                flat = ids[np.arange(size)[None, :] < left[:, None]]
            else:
                lists = [self.model.merge(data[s : s + size].tobytes()) for s in start[rows].tolist()]
                left = np.array([len(x) for x in lists], np.int64)
                flat = np.array([x for ids in lists for x in ids], np.int64)
            at[rows], n[rows] = used + np.cumsum(left) - left, left
            used += len(flat)
            parts.append(flat)
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32), at, n


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of the words: sorted edges with additive outputs."""
    register: dict[tuple, int] = {}
    edges_of: list[tuple] = []
    count: list[int] = []

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        got = register.get(key)
        if got is None:
            got = register[key] = len(edges_of)
            edges_of.append(key)
            count.append(node[0] + sum(count[t] for _, t in node[1]))
        return got

    stack: list[list] = [[0, []]]
    previous = b""
    order = sorted(words)
    for word in order:
        same = len(os.path.commonprefix([word, previous]))
        while len(stack) - 1 > same:
            node = stack.pop()
            stack[-1][1].append((previous[len(stack) - 1], close(node)))
        for _ in word[same:]:
            stack.append([0, []])
        stack[-1][0] = 1
        previous = word
    while len(stack) > 1:
        node = stack.pop()
        stack[-1][1].append((previous[len(stack) - 1], close(node)))
    root = close(stack[0])
    key, to, out = [], [], []
    for state, (final, edges) in enumerate(edges_of):
        passed = final
        for label, target in edges:
            key.append(state << 8 | label)
            to.append(target)
            out.append(passed)
            passed += count[target]
    ids = [words[w] for w in order]
    return {
        "key": np.array(key, np.int64), "to": np.array(to, np.int32), "out": np.array(out, np.int32),
        "final": np.array([f for f, _ in edges_of], np.bool_), "root": np.array([root], np.int64),
        "ids": np.array([x for row in ids for x in row], np.uint32), "at": np.cumsum([0, *map(len, ids)]).astype(np.int64),
    }


class Lexicon:
    """A compiled transducer, opened by memory map from one local file."""

    NAMES = ("key", "to", "out", "final", "root", "ids", "at")

    def __init__(self, packed: bytes):
        with tempfile.NamedTemporaryFile(prefix="lexicon-") as f:  # the maps outlive the name
            f.write(packed)
            f.flush()
            at = int.from_bytes(packed[-8:], "little")
            head = json.loads(packed[at:-8])
            for name in self.NAMES:
                kind, at, n = head[name]
                setattr(self, name, np.memmap(f.name, np.dtype(kind), "r", at, (n,)) if n else np.zeros(0, kind))

    @staticmethod
    def pack(arrays: dict[str, np.ndarray]) -> bytes:
        body, head = io.BytesIO(), {}
        for name, a in arrays.items():
            body.write(b"\0" * (-body.tell() % 64))
            head[name] = (a.dtype.str, body.tell(), len(a))
            body.write(a.tobytes())
        at = body.tell()
        body.write(json.dumps(head).encode())
        body.write(at.to_bytes(8, "little"))
        return body.getvalue()

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Index of each word in the lexicon, -1 for those outside it."""
        n = len(start)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return found
        alive = np.arange(n)
        state = np.full(n, self.root[0])
        total = np.zeros(n, np.int64)
        for step in range(int(length.max()) + 1):
            done = length[alive] == step
            if done.any():
                ends = done & self.final[state]
                found[alive[ends]] = total[ends]
                alive, state, total = alive[~done], state[~done], total[~done]
            if not len(alive):
                break
            want = (state << 8) | data[start[alive] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            at, alive = at[hit], alive[hit]
            state, total = self.to[at].astype(np.int64), total[hit] + self.out[at]
        return found


def letter_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other.

    Where two installed Unicode tables differ in age, the tokenizers library decides.
    """
    kinds = {"L": LETTER, "N": NUMBER}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = np.zeros(0x110000, np.uint8)
    table[points] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in points]
    try:
        import regex
        from tokenizers import pre_tokenizers
    except ImportError:
        pass
    else:
        newer = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, points))
        for kind, rule in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(rule, every):
                newer[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        newer[0xD800:0xE000] = OTHER
        split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in np.flatnonzero(newer != table).tolist():
            parts = [x for _, x in split(f"a{chr(c)}1")]
            table[c] = LETTER if parts == [(0, 2), (2, 3)] else NUMBER if parts == [(0, 1), (1, 3)] else OTHER
    table[list(WHITE_SPACE)] = BLANK
    return table


def pretokens(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and length of each pre-token of a chunk of texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    at = np.flatnonzero((data & 0xC0) != 0x80) if len(code) < len(data) else np.arange(len(data))
    n = len(code)
    kind = table[code]
    fresh = np.zeros(n + 3, bool)  # first code points of texts
    fresh[np.searchsorted(at, off[:-1][off[:-1] < off[1:]])] = True
    fresh[n:] = True
    start = fresh.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    p = np.flatnonzero(blank[:-1] & ~blank[1:] & ~fresh[1:n])  # last blank before ink
    start[p] = True
    start[p[code[p] == 32] + 1] = False
    a = np.flatnonzero(code == 39)
    a = a[start[a] & ~fresh[a + 1]]
    if len(a):
        pad = np.concatenate([code, np.zeros(3, np.uint32)])
        one, two = pad[a + 1], pad[a + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~fresh[a + 2]
        start[a[single | pair] + 1] = False
        start[a[single] + 2] = True
        start[a[pair] + 2] = False
        start[a[pair] + 3] = True
    begin = at[np.flatnonzero(start[:n])]
    return begin, np.diff(np.append(begin, len(data)))


def _segments(data: np.ndarray, off: np.ndarray, added: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts at added tokens: offsets of pieces, their documents, added id or -1."""
    raw = data.tobytes()
    marks = [t.encode() for t in added]
    if not any(m in raw for m in marks):
        return off, np.arange(len(off) - 1), np.full(len(off) - 1, -1, np.int64)
    rule = re.compile(b"|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)))
    cuts, doc, ids = [0], [], []
    for i in range(len(off) - 1):
        at = int(off[i])
        for m in rule.finditer(raw, int(off[i]), int(off[i + 1])):
            cuts += [m.start(), m.end()]
            doc += [i, i]
            ids += [-1, added[m[0].decode()]]
            at = m.end()
        cuts.append(int(off[i + 1]))
        doc.append(i)
        ids.append(-1)
    return np.array(cuts, np.int64), np.array(doc, np.int64), np.array(ids, np.int64)


class Encoder:
    """Encodes chunks of texts with a model and a lexicon."""

    def __init__(self, model: Model, lexicon: Lexicon | None, table: np.ndarray):
        self.model, self.lexicon, self.table = model, lexicon, table
        self.merger = Merger(model)
        size = np.array([len(p) for p in model.pieces], np.int64)
        self.size, self.at = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(model.pieces), np.uint8)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets (n + 1) of each text's ids."""
        cuts, doc, special = _segments(data, off, self.model.added)
        start, length = pretokens(data, cuts, self.table)
        first, inverse = distinct_ranges(data, start, length)
        ws, wl = start[first], length[first]
        index = self.lexicon.find(data, ws, wl) if self.lexicon is not None else np.full(len(ws), -1, np.int64)
        if self.lexicon is not None and len(self.lexicon.at) > 1:
            base, known = self.lexicon.ids, np.maximum(index, 0)
            w_at, w_n = np.array(self.lexicon.at[known]), np.array(self.lexicon.at[known + 1] - self.lexicon.at[known])
        else:
            base, w_at, w_n = np.zeros(0, np.uint32), np.zeros(len(ws), np.int64), np.zeros(len(ws), np.int64)
        new = np.flatnonzero(index < 0)
        merged, m_at, m_n = self.merger.merge(data, ws[new], wl[new])
        w_at[new], w_n[new] = m_at + len(base), m_n
        pool = np.concatenate([np.asarray(base), merged])
        part = np.searchsorted(cuts, start, side="right") - 1  # piece of each word; empty pieces have none
        word_at, word_n, word_doc = w_at[inverse], w_n[inverse], doc[part]
        mark = np.flatnonzero(special >= 0)
        if len(mark):  # an added token is one id in place of its piece's words
            keep = special[part] < 0
            pool = np.concatenate([pool, special[mark].astype(np.uint32)])
            place = np.concatenate([start[keep], cuts[mark]])
            order = np.argsort(place, kind="stable")
            word_at = np.concatenate([word_at[keep], len(pool) - len(mark) + np.arange(len(mark))])[order]
            word_n = np.concatenate([word_n[keep], np.ones(len(mark), np.int64)])[order]
            word_doc = np.concatenate([word_doc[keep], doc[mark]])[order]
        ids = pool[ranges(word_at, word_n)]
        n = np.bincount(word_doc, weights=word_n, minlength=len(off) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(n)])

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the ids in UTF-8; broken sequences become U+FFFD."""
        raw = self.flat[ranges(self.at[ids], self.size[ids])].tobytes()
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode("utf-8")


def _counts(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in chunks(off, CHUNK):
                part = data[off[i] : off[j]]
                start, length = pretokens(part, off[i : j + 1] - off[i], table.value)
                first, which = distinct_ranges(part, start, length)
                n = np.bincount(which, minlength=len(first))
                keep = (n > 1) & (length[first] <= 64)
                s, size = start[first[keep]], length[first[keep]]
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                flat = part[ranges(s, size)]
                word = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(at), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([word, pa.array(n[keep].astype(np.int64))], ["word", "n"])

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n long): occurrences of frequent pre-tokens of up to 64 bytes in all texts.

    Lossy counting: a word met once within a chunk of CHUNK bytes is not passed on, so a
    count is too low by at most the number of chunks.
    """
    table = docs.sparkSession.sparkContext.broadcast(letter_classes())
    return docs.select("text").mapInArrow(_counts(table), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, model: Model, size: int = LEXICON_SIZE) -> bytes:
    """Compile the most frequent words, ``size`` at most.

    A histogram of the counts, in eighths of powers of two, gives the least count
    that keeps no more than ``size`` words, so only those reach the driver.
    """
    counts = stage_table(word_counts(docs), "words")
    level = F.floor(F.log2("n") * 8)
    least, kept = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        kept += r["count"]
        if kept > size:
            break
        least = r["level"]
    top = [] if least is None else sorted(counts.where(level >= least).select("word").toPandas()["word"].map(bytes))
    drop_staged(counts)
    words = top
    size = np.array([len(w) for w in words], np.int64)
    ids, at, n = Merger(model).merge(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    return Lexicon.pack(compile_lexicon({w: ids[i : i + k].tolist() for w, i, k in zip(words, at.tolist(), n.tolist())}))


def _encode_batches(text, packed, table, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if encoder is None:
                encoder = Encoder(Model(text.value), Lexicon(packed.value), table.value)
            data, off = utf8(batch.column(1))
            for i, j in chunks(off, CHUNK):
                ids, at = encoder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = ids.astype("<u4")
                ids_sha, text_sha, backs = [], [], []
                for k in range(j - i):
                    mine = ids[at[k] : at[k + 1]]
                    back = encoder.decode(mine)
                    ids_sha.append(hashlib.sha256(mine).hexdigest())
                    text_sha.append(hashlib.sha256(back).hexdigest())
                    if full:
                        backs.append(back.decode())
                cols = [batch.column(0)[i:j], pa.array(np.diff(at)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    cols += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32))), pa.array(backs, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def bpe(docs: DataFrame, model_path: str | None = None, lexicon_size: int = LEXICON_SIZE, full: bool = False) -> DataFrame:
    """Encode each text and decode its ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers) and decoded_sha256 (of the decoded text in UTF-8); with
    ``full`` also ids and decoded.  Null texts count as empty: no ids.  Repeated
    rows and null ids are kept as they are, other columns are ignored, and an
    empty table gives an empty result.  The file at ``model_path`` is read on
    the driver and its text is broadcast: its size does not grow with the data.
    """
    spark = docs.sparkSession
    with open(model_path or default_model(), encoding="utf-8") as f:
        text = f.read()
    sc = spark.sparkContext
    packed = sc.broadcast(build_lexicon(docs, Model(text), lexicon_size))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if full:
        schema += ", ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode_batches(sc.broadcast(text), packed, sc.broadcast(letter_classes()), full), schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}
