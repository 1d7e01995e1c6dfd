"""Token ids in Arrow stream files of equal-length sequences.

A shard holds a run of documents in ascending doc_id order. Its ids are cut
into sequences of ``seq_len``, kept as ``fixed_size_list`` columns, and every
record batch holds ``batch_rows`` sequences: all batches of a file then have
the same size, so batch ``i`` lies at ``start + i * stride`` and is read in
place from a memory map without a footer or an index of batches. ``mask`` is
false on the padding after a shard's last id. A second stream file lists the
documents of the shard with their offsets, since an id alone cannot mark an
end: the end id may occur inside a text.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstrata.llm.common import new_folder

#: Distinct words that a Python worker keeps encoded; beyond it the memory is emptied, results stay the same.
CACHE_WORDS = 600_000
#: Bytes of the table that make a shard, and tasks for every core at least.
SHARD_BYTES, TASKS_A_CORE = 128 << 20, 4
#: Bytes of text that go to the tokenizer in one call, so that its result objects stay small.
CALL_BYTES = 1 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_LOADED: dict[str, tuple] = {}


#: The splitter of byte-level BPE files.
SPLITTER = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that some library counts as white space, besides blank and line feed.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
#: Beyond this character, words go through the library whole: letter classes below it are the same in every Unicode version.
LATIN_END = "\u0250"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in such files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes whole texts with a byte-level BPE file, remembering words.

    The file's splitter never lets a token cross from one word to the next
    where single blanks or line feeds part the words, so a text is the
    concatenation of its blank-led words and line feeds. A new word is split
    by the file's pattern and each piece goes through the file's BPE model.
    Any text with other white space, two white-space characters in a row or
    one at either end, or a special token's string goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces = regex.compile(SPLITTER).findall
        self.alphabet = byte_alphabet()
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def regular(self, t: str) -> bool:
        """Whether single blanks and line feeds alone part the words of ``t``, and nothing in it is special."""
        if t[0] in " \n" or t[-1] in " \n" or "  " in t or "\n\n" in t or " \n" in t or "\n " in t or "\0" in t:
            return False
        return not any(c in t for c in OTHER_SPACE) and not any(x in t for x in self.special)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``."""
        return [self.encode(t) for t in texts]

    def encode(self, t: str) -> bytes:
        if not t:
            return b""
        if not self.regular(t):
            return self._ids(self.whole.encode(t, add_special_tokens=False).ids)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        words = t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known[w] if w in known else self._word(w) for w in words])

    def _word(self, w: str) -> bytes:
        if not w.isascii() and max(w) >= LATIN_END:
            ids = self._ids(self.whole.encode(w, add_special_tokens=False).ids)
        else:
            pieces = self.pieces(w)
            ids = b"".join([self.known[p] if p in self.known else self._piece(p) for p in pieces]) if len(pieces) > 1 else self._piece(w)
        self.known[w] = ids
        return ids

    def _piece(self, p: str) -> bytes:
        ids = self._ids([t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.alphabet))])
        self.known[p] = ids
        return ids

    def _ids(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()


def encoder(path: str) -> WordEncoder:
    """One encoder per file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = (WordEncoder(path),)
    return _LOADED[path][0]


def by_bytes(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts with ``most`` characters at most; a longer text is a run of its own."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > most:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def schema_of(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class StreamWriter:
    """Appends ids to one shard; every batch but none other than full ones is written."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int, batch_rows: int) -> None:
        self.dtype, self.seq_len, self.size = dtype, seq_len, seq_len * batch_rows
        self.out = pa.ipc.new_stream(sink, schema_of(dtype, seq_len))
        self.held: list[bytes] = []
        self.n_held = self.n = 0

    def append(self, ids: bytes) -> None:
        self.held.append(ids)
        count = len(ids) // self.dtype.itemsize
        self.n_held += count
        self.n += count
        if self.n_held >= self.size:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        full = len(ids) // self.size * self.size
        for at in range(0, full, self.size):
            self._batch(ids[at : at + self.size], self.size)
        rest = ids[full:]
        if last and len(rest):
            self._batch(np.concatenate([rest, np.zeros(self.size - len(rest), self.dtype)]), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest.tobytes()], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(self.size) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.seq_len) for x in (pa.array(ids), mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema_of(self.dtype, self.seq_len)))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class StreamReader:
    """Random access to the sequences of a shard. Nothing is copied where the file is memory-mapped."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        stream = pa.ipc.open_stream(source)
        self.schema, self.first = stream.schema, source.tell()
        self.seq_len = self.schema.field("ids").type.list_size
        try:
            self.batch_rows = stream.read_next_batch().num_rows
            self.stride = source.tell() - self.first
        except StopIteration:
            self.batch_rows = self.stride = 0
        self.n_batches = (source.size() - self.first) // self.stride if self.stride else 0

    def batch(self, i: int) -> pa.RecordBatch:
        """Batch ``i``, found by arithmetic alone."""
        if not 0 <= i < self.n_batches:
            raise IndexError(i)
        self.source.seek(self.first + i * self.stride)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        b, row = self.batch(i // self.batch_rows), i % self.batch_rows
        at = slice(row * self.seq_len, (row + 1) * self.seq_len)
        return b.column(0).flatten().to_numpy(zero_copy_only=True)[at], b.column(1).flatten()[at]

    def spans(self, starts: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of many spans in ascending order; each batch is opened once."""
        size, at, ids = self.seq_len * self.batch_rows, -1, None
        for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
            got = []
            while n > 0:
                if start // size != at:
                    at = start // size
                    ids = self.batch(at).column(0).flatten().to_numpy(zero_copy_only=True)
                got.append(ids[start - at * size : start - at * size + n])
                start += len(got[-1])
                n -= len(got[-1])
            yield got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, self.schema.field("ids").type.value_type.to_pandas_dtype())


def opened(uri: str) -> pa.NativeFile:
    """The file for reading, memory-mapped where its store is this machine's file system."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def size_of(rows: DataFrame) -> int:
    """Bytes of a table as its files tell them, without a scan; where the plan cannot tell, the texts are added up."""
    told = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if told < 1 << 52:  # beyond it Spark has put a stand-in
        return told
    return rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def write_stream_files(docs: DataFrame, tokenizer: str, folder: str | None = None, seq_len: int = 2048, batch_rows: int = 16, end_id: int = 0) -> list[dict]:
    """Encode ``docs(doc_id, text)`` and write its shards; the list of shards in order.

    The table is dealt out by ranges of doc_id and sorted within them, so no
    task holds more than its range, and the shards' order is the documents'.
    A null text counts as empty and gives the end id alone; a null doc_id
    comes first; repeated ids follow one another in text order. An empty
    table has no shards. Other columns are not read. A shard is named by its
    attempt, so a repeated task never meets half a file; files of attempts
    that came to nothing are not listed. One small row per shard reaches the
    driver, none per document.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        work, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], work.dtype).tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        out = None
        n_docs = 0
        for b in batches:
            ids, texts, at = b.column(0), [t or "" for t in b.column(1).to_pylist()], 0
            lens = []
            for run in by_bytes(texts, CALL_BYTES):
                if out is None:
                    store.create_dir(root, recursive=True)
                    sinks = [store.open_output_stream(f"{name}.{x}.arrows") for x in ("ids", "docs")]
                    out, index = StreamWriter(sinks[0], work.dtype, seq_len, batch_rows), pa.ipc.new_stream(sinks[1], INDEX)
                for got in work.encode_all(run):
                    out.append(got + end)
                    lens.append(len(got) // work.dtype.itemsize + 1)
                    at += 1
            if at:
                n = np.array(lens, np.int64)
                first = out.n - n.sum()
                index.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(first + np.cumsum(n) - n), pa.array(n)], schema=INDEX))
                n_docs += at
        if out is not None:
            out.close()
            index.close()
            for s in sinks:
                s.close()
            base = folder.rstrip("/") + "/" + name.rpartition("/")[2]
            yield pa.RecordBatch.from_pydict({"shard": [shard], "base": [base], "n_docs": [n_docs], "n_tokens": [out.n]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-size_of(rows) // SHARD_BYTES))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = dealt.mapInArrow(encode, "shard long, base string, n_docs long, n_tokens long").collect()
    found, start = [], 0
    for s in sorted(shards, key=lambda s: s["shard"]):
        found.append(s.asDict() | {"start": start})
        start += s["n_tokens"]
    return found


def read_digests(spark, shards: list[dict]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and its shard and place there.

    The shards are a table of one row for each task, so a task is told of its
    own file only.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, shard_start long"
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                ids = StreamReader(opened(f"{s['base']}.ids.arrows"))
                for docs in pa.ipc.open_stream(opened(f"{s['base']}.docs.arrows")):
                    at, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids.spans(at, n)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(at + s["start"]), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), s["shard"], np.int64)), pa.array(at)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_start"])

    told = spark.createDataFrame([(s["shard"], s["base"], s["start"]) for s in shards], "shard long, base string, start long")
    return told.repartitionByRange(len(shards), "shard").mapInArrow(read, schema)
