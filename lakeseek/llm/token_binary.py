"""Token ids in binary files: static range asymmetric numeral coding.

One frequency table over the ids of all documents is shared by all files.
Documents are put in ascending order of id, tokenized, and their ids cut into
blocks. A block is coded by itself in interleaved lanes: every numpy step
codes one id in each lane. Checkpoints inside a block hold the lane states, so
that a reader may start there; each block carries a CRC-32 of its ids.

File: ``LSRANS1\\n``, blocks, footer (JSON: block places, counts, checksums,
checkpoints), documents (doc ids as an Arrow stream, lengths as int64), two
8-byte lengths, ``LSRANS1\\n``.

Edge cases: a null or empty text has the end id alone; repeated rows are
stored each; rows of one id lie together, ordered by text; a null id comes
first; an empty table gives no documents.
"""

from __future__ import annotations

import io
import json
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as tx
from ._shared import file_system, shared_dir, small_batches, tidied

MAGIC = b"LSRANS1\n"
LANES = 2048
BLOCK = LANES * 256
CHECK_STEPS = 128
SCALE = 20
_U = np.uint64


# coder


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to ``2**scale``, at least 1 for every id that occurs."""
    total, room = int(counts.sum()), 1 << scale
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    seen = counts > 0
    if int(seen.sum()) > room:
        raise ValueError("more distinct ids than the frequency scale has slots")
    freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * (room / total)).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    left = room - int(freq.sum())
    if left > 0:
        freq[order[0]] += left
    for i in order:
        if left >= 0:
            break
        cut = min(-left, int(freq[i]) - 1)
        freq[i] -= cut
        left += cut
    return freq


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = scale
        self.freq = freq.astype(_U)
        self.cum = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(_U)
        # the state must stay under 2**64 after a step: flush above freq * 2**(64 - scale)
        self.limit = self.freq << _U(64 - scale)
        self.whole = self.freq == _U(1 << scale)
        self.ids = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECK_STEPS) -> tuple[bytes, list[dict]]:
        """Words of a block, last step coded first; checkpoints as (step, word offset, states)."""
        n = len(ids)
        steps = -(-n // lanes)
        x = np.full(lanes, 1 << 32, _U)
        out: list[np.ndarray] = []
        back = 0
        marks = []
        f, c, m, sh = self.freq, self.cum, _U(32), _U(self.scale)
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            k = len(s)
            fs = f[s]
            y = x[:k]
            full = (y >= self.limit[s]) & ~self.whole[s]
            if full.any():
                out.append(y[full].astype(np.uint32))
                back += len(out[-1])
                y = np.where(full, y >> m, y)
            q = y // fs
            x[:k] = (q << sh) + (y - q * fs) + c[s]
            if t % every == 0:
                marks.append((t, back, x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        points = [{"step": t, "word": back - b, "state": v} for t, b, v in reversed(marks)]
        return words.astype("<u4").tobytes(), points

    def decode(self, words: np.ndarray, n: int, state: np.ndarray, step: int = 0, until: int | None = None, word: int = 0) -> np.ndarray:
        """Ids of the steps ``step:until`` of a block of ``n`` ids."""
        lanes = len(state)
        steps = -(-n // lanes) if until is None else until
        x = state.astype(_U, copy=True)
        out = np.empty(min(n, steps * lanes) - step * lanes, np.uint32)
        mask, sh, low = _U((1 << self.scale) - 1), _U(self.scale), _U(1 << 32)
        at, p = 0, word
        for t in range(step, steps):
            k = min(lanes, n - t * lanes)
            y = x[:k]
            slot = y & mask
            s = self.ids[slot]
            out[at : at + k] = s
            at += k
            y = self.freq[s] * (y >> sh) + slot - self.cum[s]
            need = np.flatnonzero(y < low)
            if len(need):
                y[need] = (y[need] << _U(32)) | words[p : p + len(need)]
                p += len(need)
            x[:k] = y
        return out


# tokenizer


class Memo:
    """Open-addressing table from word hashes to runs of ids, looked up for whole arrays at once."""

    def __init__(self, kind: str, bits: int = 22):
        self.mask = (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros(1024, _U)
        self.at, self.len = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used, self.n = np.zeros(4096, kind), 0, 0

    def room(self, more: int) -> bool:
        return 2 * (self.n + more) <= self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        slot = (h & _U(self.mask)).astype(np.int64)
        out = self.slot[slot]
        rest = np.flatnonzero((out >= 0) & (self.key[out] != h))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            e = self.slot[slot[rest]]
            out[rest] = e
            rest = rest[(e >= 0) & (self.key[e] != h[rest])]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Adds hashes that it doesn't hold, all different, with their runs of ids in a row."""
        n, first = len(h), self.n
        while self.n + n > len(self.key):
            self.key, self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.key, self.at, self.len))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.key[first : first + n] = h
        self.len[first : first + n] = size
        self.at[first : first + n] = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += n
        slot, rest = (h & _U(self.mask)).astype(np.int64), np.arange(n)
        while len(rest):
            free = rest[self.slot[slot[rest]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            self.slot[slot[free[one]]] = first + free[one]
            rest = rest[self.slot[slot[rest]] != first + rest]
            slot[rest] = (slot[rest] + 1) & self.mask


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE vocabularies write for bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class TokenIds:
    """Ids of texts by the tokenizers library.

    Where the tokenizer drops white space and cuts there (its pattern never
    matches it), the ids of a text are those of its words in a row. Each
    distinct word is then encoded once and kept in a table of bounded size by
    a 64-bit hash. Words of ASCII and Latin-1 letters are cut by the
    tokenizer's own pattern and go to the library's BPE model piece by piece;
    all others take the library's whole way.
    """

    def __init__(self, path: str, bits: int = 22):
        import re

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind, self.code = ("<u2", "H") if size <= 1 << 16 else ("<u4", "I")
        spec = json.loads(open(path, encoding="utf-8").read())
        self.by_word = self._cuts_at_blanks(spec)
        self.memo, self.pieces = Memo(self.kind, bits), {}
        self.model = self.tok.model
        self.plain = re.compile(r"[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
        self.letter = _byte_letters()

    @staticmethod
    def _cuts_at_blanks(spec: dict) -> bool:
        norm = spec.get("normalizer") or {}
        pre = spec.get("pre_tokenizer") or {}
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        steps = pre.get("pretokenizers") or []
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        return bool(
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0].get("pattern") == {"Regex": pattern}
            and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and not spec.get("post_processor")
            and spec.get("model", {}).get("type") == "BPE"
        )

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.letter.__getitem__, piece.encode()))
        ids = array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()
        if len(self.pieces) < 300_000:
            self.pieces[piece] = ids
        return ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        known, cut, plain, make = self.pieces, self.cut.findall, self.plain.fullmatch, self._piece
        out: list = []
        rare = []
        for i, w in enumerate(words):
            if plain(w):
                parts = cut(w.lower())
                if len(parts) == 1:
                    out.append(known.get(parts[0]) or make(parts[0]))
                else:
                    out.append(b"".join([known.get(p) or make(p) for p in parts]))
            else:
                out.append(b"")
                rare.append(i)
        if rare:
            for i, e in zip(rare, self.tok.encode_batch([words[i] for i in rare], add_special_tokens=False)):
                out[i] = array(self.code, e.ids).tobytes()
        width = np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(out), self.kind), np.fromiter(map(len, out), np.int64, len(out)) // width

    def __call__(self, buf: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents in a row, each with the end id, and their numbers."""
        n_docs = len(off) - 1
        if not self.by_word:
            got = self.tok.encode_batch([buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])], add_special_tokens=False)
            ids = np.concatenate([np.array([*e.ids, end], self.kind) for e in got]) if got else np.zeros(0, self.kind)
            return ids, np.array([len(e.ids) + 1 for e in got], np.int64)
        w = tx.scan(buf, off)
        if not self.memo.room(len(w.hash)):
            self.memo = Memo(self.kind, max(self.memo.mask.bit_length(), (4 * len(w.hash)).bit_length()))
        entry = self.memo.find(w.hash)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            h, one = np.unique(w.hash[miss], return_index=True)
            at = miss[one]
            raw = buf.tobytes()
            self.memo.add(h, *self.encode_words([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]))
            entry[miss] = self.memo.find(w.hash[miss])
        size = self.memo.len[entry]
        ends = np.concatenate([[0], np.cumsum(size)])
        per = ends[w.off[1:]] - ends[w.off[:-1]]
        ids = self.memo.pool[np.repeat(self.memo.at[entry] - ends[:-1], size) + np.arange(ends[-1])]
        out = np.full(len(ids) + n_docs, end, self.kind)
        out[np.arange(len(ids)) + np.repeat(np.arange(n_docs), per)] = ids
        return out, per + 1


def _tokens(path: str) -> TokenIds:
    kept = sys.__dict__.setdefault("_lakeseek_tokens", {})
    if path not in kept:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept[path] = TokenIds(path)
    return kept[path]


def id_counts(docs: DataFrame, tokenizer: str, text: str = "text", end: int = 2) -> np.ndarray:
    """How often each id occurs in all documents: one row an id and task is shuffled, one an id collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokens(tokenizer)
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, buf, off in tx.slices(batch, text):
                ids, _ = tok(buf, off, end)
                now = np.bincount(ids, minlength=len(total))
                now[: len(total)] += total
                total = now
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    rows = docs.select(text).mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([end, *(r[0] for r in rows)]) + 1, np.int64)
    for i, n in rows:
        counts[i] = n
    return counts


# files


class Writer:
    """One file: ids go in, blocks go out as they fill."""

    def __init__(self, sink, coder: Coder):
        self.sink, self.coder = sink, coder
        self.place, self.blocks, self.ready, self.have = 0, [], [], 0
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.sink.write(b)
        self.place += len(b)

    def add(self, ids: np.ndarray) -> None:
        self.ready.append(ids)
        self.have += len(ids)
        if self.have >= BLOCK:
            every = np.concatenate(self.ready)
            cut = len(every) // BLOCK * BLOCK
            for k in range(0, cut, BLOCK):
                self._block(every[k : k + BLOCK])
            self.ready, self.have = [every[cut:]], len(every) - cut

    def _block(self, ids: np.ndarray) -> None:
        lanes = min(LANES, max(1, len(ids) // 64))
        body, points = self.coder.encode(ids, lanes)
        at = self.place
        self._put(body)
        marks = [{"step": p["step"], "word": p["word"]} for p in points]
        for p in points:
            self._put(p["state"].astype("<u8").tobytes())
        self.blocks.append({"at": at, "bytes": len(body), "n": len(ids), "lanes": lanes, "crc": zlib.crc32(ids.astype("<u4").tobytes()), "marks": marks})

    def close(self, doc_ids: pa.Array, lengths: np.ndarray) -> int:
        if self.have:
            self._block(np.concatenate(self.ready))
        foot = json.dumps({"blocks": self.blocks, "scale": self.coder.scale, "documents": len(lengths)}).encode()
        self._put(foot)
        stream = io.BytesIO()
        table = pa.table({"doc_id": doc_ids, "n": pa.array(lengths.astype(np.int64))})
        with pa.ipc.new_stream(stream, table.schema) as w:
            w.write_table(table)
        self._put(stream.getvalue())
        self._put(struct.pack("<QQ", len(foot), stream.tell()) + MAGIC)
        return self.place


def read_file(source, coder: Coder, block: int | None = None, mark: int = 0) -> Iterator[np.ndarray] | np.ndarray:
    """Ids of the blocks of an open file, each checked; or those of one block from a checkpoint on."""
    foot, _ = read_foot(source)

    def load(b: dict, k: int) -> np.ndarray:
        source.seek(b["at"])
        words = np.frombuffer(source.read(b["bytes"]), "<u4")
        source.seek(b["at"] + b["bytes"] + 8 * b["lanes"] * k)
        state = np.frombuffer(source.read(8 * b["lanes"]), "<u8")
        m = b["marks"][k]
        ids = coder.decode(words, b["n"], state, m["step"], None, m["word"])
        if k == 0 and zlib.crc32(ids.astype("<u4").tobytes()) != b["crc"]:
            raise ValueError("checksum of a block differs")
        return ids

    if block is not None:
        return load(foot["blocks"][block], mark)
    return (load(b, 0) for b in foot["blocks"])


def read_foot(source) -> tuple[dict, pa.Table]:
    source.seek(0, 2)
    size = source.tell()
    source.seek(size - 24)
    tail = source.read(24)
    if tail[16:] != MAGIC:
        raise ValueError("not a token file")
    n, m = struct.unpack("<QQ", tail[:16])
    source.seek(size - 24 - m - n)
    foot = json.loads(source.read(n))
    return foot, pa.ipc.open_stream(source.read(m)).read_all()


def write_tokens(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int = 2, partitions: int | None = None) -> list[tuple[str, int, int]]:
    """Writes the files under ``path``; returns (file, documents, ids) in ascending order of id.

    A task writes under a name of its own attempt and renames at its end, so a
    retried or doubled task leaves one whole file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = id_counts(docs, tokenizer, "text", end)
    freq = quantise(counts)
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/frequencies.bin") as f:
        f.write(freq.astype("<u4").tobytes())
    table = spark.sparkContext.broadcast(freq)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, coder = _tokens(tokenizer), Coder(table.value)
        ctx = TaskContext.get()
        fs, root = file_system(path)
        name = f"part-{ctx.partitionId():06d}.rans"
        draft = f"{root}/.{name}.{ctx.taskAttemptId()}"
        ids, lengths = [], []
        with fs.open_output_stream(draft) as sink:
            out = Writer(sink, coder)
            for batch in batches:
                ids.append(batch.column(0))
                for _, buf, off in tx.slices(batch, "text"):
                    some, n = tok(buf, off, end)
                    lengths.append(n)
                    out.add(some)
            n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            out.close(pa.concat_arrays(ids) if ids else pa.array([], pa.int64()), n)
        fs.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([ctx.partitionId()], pa.int64()), pa.array([name]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["part", "name", "docs", "ids"])

    ordered = docs.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = ordered.mapInArrow(tidied(run), "part long, name string, docs long, ids long").collect()
    parts = [(r[1], r[2], r[3]) for r in sorted(rows)]
    with fs.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps({"tokenizer": tokenizer.rsplit("/", 1)[-1], "end": end, "parts": parts}).encode())
    return parts


def read_tokens(spark: SparkSession, path: str, schema, with_ids: bool = False) -> DataFrame:
    """One row a document, from the files: id, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``.

    ``schema``: the schema of the documents, for the type of ``doc_id``.
    """
    fs, root = file_system(path)
    with fs.open_input_stream(f"{root}/index.json") as f:
        parts = json.loads(f.read())["parts"]
    rows, start = [], 0
    for name, n_docs, n_ids in parts:
        if n_docs:
            rows.append((len(rows), name, start))
        start += n_ids
    kind = schema["doc_id"].dataType
    out = f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        with fs.open_input_stream(f"{root}/frequencies.bin") as f:
            coder = Coder(np.frombuffer(f.read(), "<u4").astype(np.int64))
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['name']}") as source:
                    _, index = read_foot(source)
                    doc_ids = index.column(0).combine_chunks()
                    lengths = index.column(1).to_numpy()
                    ends = np.cumsum(lengths)
                    crc, lists = np.zeros(len(lengths), np.int64), [[] for _ in lengths] if with_ids else None
                    at, d = 0, 0
                    for ids in read_file(source, coder):
                        data = memoryview(ids.astype("<u4").tobytes())
                        p = 0
                        while p < len(ids):
                            take = min(len(ids) - p, int(ends[d]) - at)
                            crc[d] = zlib.crc32(data[4 * p : 4 * (p + take)], int(crc[d]))
                            if with_ids:
                                lists[d].extend(ids[p : p + take].tolist())
                            p += take
                            at += take
                            if at == ends[d]:
                                d += 1
                    arrays = [doc_ids, pa.array(ends - lengths + row["start"]), pa.array(lengths), pa.array(crc)]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.array(lists, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    if not rows:
        return spark.createDataFrame([], out)
    return spark.createDataFrame(rows, "part int, name string, start long").repartitionById(len(rows), F.col("part")).mapInArrow(tidied(run), out)


def token_binary(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 2, path: str | None = None) -> DataFrame:
    """Writes all documents as token files and returns what the files hold."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens"
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    write_tokens(docs, tokenizer, path, end=end)
    return read_tokens(spark, path, docs.schema)
