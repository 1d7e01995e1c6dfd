"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's encoding is the path of greatest total score through the lattice of
the vocabulary's pieces (a unigram reading: every piece counts its score).
Ties go to the longer last piece. Where no piece crosses from one word to the
next, words are encoded apart and remembered.

A giant document is cut into chunks at arbitrary places. Pieces may cross a
cut by up to ``L - 1`` characters, so a cut has L states: how far the piece
that reaches it sticks out. A chunk's transfer matrix holds the best score
from each state at its start to each at its end. Such matrices combine
associatively in max-plus algebra, and a scan of their products gives the
best score of every state at every cut. With these each chunk finds, on its
own, for each way out the way in; composing those maps from the end fixes the
states of the path, and each chunk is then traced back independently.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstrata.llm.common import written

#: The blank's symbol.
BLANK = "▁"
#: Characters beyond which a document is cut, and those of a chunk.
GIANT, CHUNK = 1 << 16, 1 << 14
#: Words that a Python worker keeps; beyond it the memory is emptied, results stay the same.
CACHE_WORDS = 600_000
#: Words of more characters are searched alone. Documents whose new words are searched together.
LONG_WORD, TOGETHER = 40, 512
NONE = -(1 << 60)
HASH_BY = 0x9E3779B97F4A7C15
_LOADED: dict[str, Pieces] = {}
_LETTER = re.compile(r"[^\W\d_]")


class Pieces:
    """A vocabulary: pieces with whole-number scores, byte pieces for what it lacks."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = [0] * 256
        self.text: list[str | int | None] = [None] * n
        self.piece: dict[str, tuple[int, int]] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b] = i
                self.text[i] = chr(b) if b < 128 else b
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[p] = (i, round(sp.get_score(i)))
                self.text[i] = p
        self.unknown = min(s for _, s in self.piece.values()) - 10
        self.most = max(map(len, self.piece))
        #: A tree of characters; a node's score is under "" where its path is a piece.
        self.tree: dict = {}
        for p, (_, score) in self.piece.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = score
        self.parts = self._parts()
        # for batches of words: characters as numbers, pieces by a hash of them
        self.number = {c: i + 1 for i, c in enumerate(sorted({c for p in self.piece for c in p}))}
        hashes = np.array([self._hash(p) for p in self.piece], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array([score for _, score in self.piece.values()], np.int64)[order]
        self.known: dict[str, bytes] = {}

    def _parts(self):
        """Cuts a text where no piece crosses, or None.

        Words part where no piece has a blank behind another character.
        Letters part from all else where no piece joins a letter to another
        character but a leading blank; then a word is one entry whatever mark
        follows it. A line feed stands alone where no piece holds one.
        """
        bare = [p.lstrip(BLANK) for p in self.piece]
        if any(BLANK in p or "\n" in p for p in bare):
            return None
        letters = [sum(_LETTER.match(c) is not None for c in p) for p in bare]
        if all(n in (0, len(p)) for n, p in zip(letters, bare, strict=True)):
            return re.compile(f"{BLANK}+[^\\W\\d_]*|[^\\W\\d_]+|\n|[^{BLANK}\n]+?(?=[^\\W\\d_]|[{BLANK}\n]|$)").findall
        return re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+").findall

    def forward(self, s: str, n: int, start: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        """Best score and last piece's start at each place of ``s``; pieces start before ``n``. ``start`` lists (place, score)."""
        best, back = [NONE] * (len(s) + 1), [-1] * (len(s) + 1)
        for at, score in start:
            best[at] = score
        tree, end = self.tree, len(s)
        for i in range(n):
            here = best[i]
            if here == NONE:
                continue
            node, j = tree, i
            while j < end:
                node = node.get(s[j])
                if node is None:
                    break
                j += 1
                score = node.get("")
                if score is not None and here + score > best[j]:
                    best[j], back[j] = here + score, i
            if s[i] not in self.piece and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
        return best, back

    def ids(self, p: str) -> list[int]:
        got = self.piece.get(p)
        return [got[0]] if got is not None else [self.byte[b] for b in p.encode("utf-8", "replace")]

    def traced(self, s: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the path that ends at ``end``, and where it starts."""
        cuts = [end]
        while back[cuts[-1]] >= 0:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in self.ids(s[a:b])], cuts[0]

    def word(self, w: str) -> bytes:
        if w not in self.known:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            _, back = self.forward(w, len(w), [(0, 0)])
            self.known[w] = array("i", self.traced(w, back, len(w))[0]).tobytes()
        return self.known[w]

    def _hash(self, p: str) -> int:
        h = 0
        for c in p:
            h = (h * HASH_BY + self.number[c]) % (1 << 64)
        return h

    def learn(self, words: list[str]) -> None:
        """Encode new words, those of one length together: the same search, place by place for all of them.

        Pieces are looked up by a 64-bit hash. A path that is no row of pieces
        shows a false match, and such a word is searched alone.
        """
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for n, same in by.items():
            if n > LONG_WORD or len(same) < 8:
                for w in same:
                    self.word(w)
                continue
            code = self.number.get
            c = np.array([[code(x, 0) for x in w] for w in same], np.uint64).T.copy()
            known = np.stack([self._found(row)[0] for row in c])  # single characters that are pieces
            best, back = np.full((n + 1, len(same)), NONE, np.int64), np.full((n + 1, len(same)), -1, np.int64)
            best[0] = 0
            for i in range(n):
                h = np.zeros(len(same), np.uint64)
                for j in range(i, min(n, i + self.most)):
                    h = h * np.uint64(HASH_BY) + c[j]
                    hit, score = self._found(h)
                    cand = np.where(hit, best[i] + score, NONE)
                    better = cand > best[j + 1]
                    best[j + 1][better], back[j + 1][better] = cand[better], i
                cand = np.where(known[i], NONE, best[i] + self.unknown)
                better = cand > best[i + 1]
                best[i + 1][better], back[i + 1][better] = cand[better], i
            piece = self.piece
            for w, come in zip(same, back.T.tolist(), strict=True):
                ids, e = [], n
                while e:
                    p = w[come[e] : e]
                    got = piece.get(p)
                    if got is not None:
                        ids.append(got[0])
                    elif len(p) == 1:
                        ids.extend(reversed(self.ids(p)))
                    else:
                        ids = None
                        break
                    e = come[e]
                if ids is None:
                    self.word(w)
                else:
                    ids.reverse()
                    self.known[w] = array("i", ids).tobytes()

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return self.hashes[at] == h, self.scores[at]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text, new words of all of them together."""
        if self.parts is None:
            return [self.encode(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        parts = [self.parts(symbols(t)) if t else [] for t in texts]
        known = self.known
        self.learn(list({w for p in parts for w in p if w not in known}))
        return [b"".join([known[w] if w in known else self.word(w) for w in p]) for p in parts]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; none for an empty text."""
        if not text:
            return b""
        s = symbols(text)
        return self.word(s) if self.parts is None else b"".join([self.word(w) for w in self.parts(s)])

    def decode(self, ids: bytes, first: bool = True) -> str:
        """The text of ids; ``first`` drops the blank that stands before every text."""
        parts = [self.text[i] for i in array("i", ids)]
        try:
            s = "".join(parts)
        except TypeError:  # bytes of characters that the vocabulary lacks
            out = bytearray()
            for t in parts:
                if isinstance(t, int):
                    out.append(t)
                elif t is not None:
                    out += t.encode()
            s = out.decode("utf-8", "replace")
        s = s.replace(BLANK, " ")
        return s[1:] if first and s.startswith(" ") else s

    def first_cut(self, s: str, n: int) -> int:
        """The first place behind all entry states, and before ``n``, that no piece crosses; 0 if there is none."""
        if self.parts is None:
            return 0
        at = 0
        for w in self.parts(s[: min(n, 64 * self.most)]):
            at += len(w)
            if at >= self.most:
                return at if at < min(n, 64 * self.most) else 0
        return 0

    def transfer(self, s: str, n: int) -> np.ndarray:
        """The matrix of a chunk of ``n`` characters, whose ``s`` reaches ``most - 1`` beyond it.

        All paths meet at a place that no piece crosses: behind the first one
        the lattice is searched once for all states, not once for each.
        """
        m = np.full((self.most, self.most), NONE, np.int64)
        c = self.first_cut(s, n)
        if c:
            tail = np.full(self.most, NONE, np.int64)
            best, _ = self.forward(s[c:], n - c, [(0, 0)])
            tail[: len(best) - (n - c)] = best[n - c : n - c + self.most]
        for i in range(min(self.most, n + 1)):
            if c:
                head = self.forward(s[:c], c, [(i, 0)])[0][c]
                m[i] = np.where((tail == NONE) | (head == NONE), NONE, tail + head)
            else:
                best, _ = self.forward(s, n, [(i, 0)])
                m[i, : len(best) - n] = best[n : n + self.most]
        return m


def symbols(text: str) -> str:
    """The text as pieces spell it: a blank in front, and blanks shown."""
    return BLANK + text.replace(" ", BLANK)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; NONE absorbs."""
    best = (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)
    return np.where(best <= NONE // 2, NONE, best)


def scan(m: np.ndarray) -> np.ndarray:
    """Products of all prefixes of a stack of matrices, in a logarithmic number of steps."""
    out, step = m.copy(), 1
    while step < len(out):
        out[step:] = times(out[:-step], out[step:])
        step *= 2
    return out


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


_DIGEST = "doc_id long, n_pieces long, ids_crc32 long, decoded_ok boolean"


def cut(text: str, size: int, over: int) -> list[tuple[int, int, str]]:
    """(number, characters, text with ``over`` more) of the chunks of a text; the last takes the rest."""
    n = max(1, len(text) // size)
    ends = [*range(size, size * n, size), len(text)]
    return [(k, e - k * size, text[k * size : e + over]) for k, e in enumerate(ends)]


def encoded(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_ok) of every row: a digest of its ids, and whether they decode to its text.

    A null or empty text has no piece and decodes. A text that holds the
    blank's own symbol decodes to blanks and says false, as the library would.
    Repeated rows each come back; an empty table gives none. Other columns
    are not read. Chunks of giant documents are rows of their own, so that no
    task holds more lattice than a chunk's.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_giant = F.coalesce(F.length("text") > giant, F.lit(False))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [x for k in range(0, len(texts), TOGETHER) for x in v.encode_all(texts[k : k + TOGETHER])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([v.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "decoded_ok"])

    return rows.where(~is_giant).mapInArrow(small, _DIGEST).unionByName(_giants(rows.where(is_giant), model, chunk))


def _giants(rows: DataFrame, model: str, chunk: int) -> DataFrame:
    """Digests of documents cut into chunks."""
    if chunk < 64:
        raise ValueError("a chunk is longer than any piece")

    @F.udf("array<struct<k: int, n: int, s: string>>", useArrow=False)
    def chunks(text):
        return cut(symbols(text), chunk, pieces(model).most - 1)

    # one row for each document, then one for each chunk; written, so that ids of rows stay
    cuts = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.explode(chunks("text")).alias("c")).select("row", "doc_id", "c.*")
    cuts = written(cuts, "chunks")

    @F.udf("binary", useArrow=False)
    def matrix(s, n):
        return pieces(model).transfer(s, n).tobytes()

    def states(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        m = np.stack([np.frombuffer(x, np.int64) for x in f["m"]])
        w = round(m.shape[1] ** 0.5)
        done = scan(m.reshape(-1, w, w))
        start = np.full((len(f), w), NONE, np.int64)
        start[0, 0] = 0
        start[1:] = done[:-1, 0]
        return pd.DataFrame({"row": f["row"], "k": f["k"], "a": [x.tobytes() for x in start]})

    dealt = cuts.repartition("row", "k")
    alpha = written(dealt.select("row", "k", matrix("s", "n").alias("m")).groupBy("row").applyInPandas(states, "row long, k int, a binary"), "states")

    def held(s, n, a):
        # a place that an entry state fixes keeps its score unless the chunk's own lattice beats it
        start = [(i, int(x)) for i, x in enumerate(np.frombuffer(bytes(a), np.int64)) if x != NONE]
        return pieces(model).forward(s, n, start)

    @F.udf("array<int>", useArrow=False)
    def ways_in(s, n, a):
        best, back = held(s, n, a)
        out = []
        for e in range(n, n + pieces(model).most):
            at = e if e < len(best) and best[e] != NONE else -1
            while at >= 0 and back[at] >= 0:
                at = back[at]
            out.append(at)
        return out

    def ways(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        state, out = 0, []
        for way in f["way"].iloc[::-1]:
            out.append(state)
            state = int(way[state])
        return pd.DataFrame({"row": f["row"], "k": f["k"], "way_out": out[::-1]})

    known = cuts.join(alpha, ["row", "k"])
    exits = written(known.select("row", "k", ways_in("s", "n", "a").alias("way")).groupBy("row").applyInPandas(ways, "row long, k int, way_out int"), "ways")

    @F.udf("struct<ids: binary, ok: boolean>", useArrow=False)
    def trace(s, n, a, way_out):
        v = pieces(model)
        _, back = held(s, n, a)
        ids, at = v.traced(s, back, n + way_out)
        packed = array("i", ids).tobytes()
        return packed, v.decode(packed, False) == s[at : n + way_out].replace(BLANK, " ") and BLANK not in s[at : n + way_out].replace(BLANK, " ")

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        crc = n = 0
        for x in f["ids"]:
            crc, n = zlib.crc32(x, crc), n + len(x) // 4
        return pd.DataFrame({"doc_id": f["doc_id"].iloc[:1], "n_pieces": [n], "ids_crc32": [crc], "decoded_ok": [bool(f["ok"].all())]})

    parts = known.join(exits, ["row", "k"]).select("row", "doc_id", "k", trace("s", "n", "a", "way_out").alias("t")).select("row", "doc_id", "k", "t.*")
    return parts.groupBy("row").applyInPandas(joined, _DIGEST)
