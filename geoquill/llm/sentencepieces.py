"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

For a BPE model a token sequence is the encoding of a text exactly if each adjacent pair of tokens is the encoding of
the pair's own text. So encoding is a path problem: states are tokens, a step weighs 0 if the pair is compatible and
minus infinity if not, and there is one path of weight 0. A giant document is cut into chunks anywhere:

1. Every chunk, on its own, yields a matrix: entry k, l is the weight of the path from state k at its left boundary (a
   token over the character before it) to state l at its right boundary. Between two places where white space begins,
   which no piece spans, the path is the same whatever the states, so the library encodes that part once.
2. Matrices are combined in the max-plus semiring, forwards and backwards, which leaves one state at every boundary.
3. Each chunk, again on its own, is traced back between its two states.

The pieces come out as the library's for the whole text. Shorter documents are one chunk: its two states are the start and the
end, its matrix is the single 0, and the trace is the library's encoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .common import file_bytes, small_batches, stored

CHUNK = 32_768
NO_PATH = -np.inf
SPACE = "▁"


class Pieces:
    """A model whose fragments can be encoded without a leading space; normalisation must leave texts as they are."""

    def __init__(self, model: bytes):
        self.whole = SentencePieceProcessor(model_proto=model)
        # the message says once more, and last, that no space is put in front
        self.part = SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        n = self.whole.get_piece_size()
        names = [self.whole.id_to_piece(i) for i in range(n)]
        self.is_byte = [self.whole.is_byte(i) for i in range(n)]
        plain = [not (self.whole.is_byte(i) or self.whole.is_control(i) or self.whole.is_unknown(i)) for i in range(n)]
        self.size = [len(p) for p in names]
        self.vocab = {p for p, ok in zip(names, plain, strict=True) if ok}
        self.reach = max(map(len, self.vocab))
        probe = " a  B Ａé "
        if self.whole.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model's normalisation changes texts")
        if any(SPACE in p.lstrip(SPACE) for p in self.vocab):
            raise ValueError("pieces span the start of white space")

    def spans(self, text: str) -> tuple[list[int], list[tuple[int, int, int, int]]]:
        """Ids of a fragment, and its tokens as (start, end, first id, end of ids); bytes of one character are one."""
        ids = self.part.encode(text)
        out, at, k = [], 0, 0
        while k < len(ids):
            if self.is_byte[ids[k]]:
                m = len(text[at].encode("utf-8"))
                out.append((at, at + 1, k, k + m))
                at, k = at + 1, k + m
            else:
                n = self.size[ids[k]] if not self.whole.is_unknown(ids[k]) else 1
                out.append((at, at + n, k, k + 1))
                at, k = at + n, k + 1
        return ids, out

    def states(self, text: str, p: int) -> list[tuple[int, int]]:
        """Tokens (start, end) that may cover the character before position ``p``."""
        out = []
        for s in range(max(0, p - self.reach), p):
            for e in range(p, min(len(text), s + self.reach) + 1):
                if text[s:e].replace(" ", SPACE) in self.vocab or e - s == 1:
                    out.append((s, e))
        return out

    def follows(self, text: str, a: tuple[int, int], first: tuple[int, int]) -> bool:
        _, got = self.spans(text[a[0] : first[1]])
        return [(s + a[0], e + a[0]) for s, e, *_ in got] == [a, first]


@lru_cache(maxsize=2)
def pieces(model: str | bytes) -> Pieces:
    """A model by its file's path, or by the file's bytes, as executors get it."""
    return Pieces(file_bytes(model) if isinstance(model, str) else model)


class Chunk:
    """Part [p, q) of a text, seen with ``reach`` characters on either side; ``text`` holds both, p and q lie in it."""

    def __init__(self, model: Pieces, text: str, p: int, q: int, first: bool, last: bool):
        self.m, self.text, self.p, self.q = model, text, p, q
        self.entries = [(p, p)] if first else model.states(text, p)
        self.exits = [(q, q)] if last else model.states(text, q)
        self.first, self.last = first, last
        lo, hi = p + model.reach + 1, q - model.reach - 1
        cuts = (w for w in range(lo, hi) if text[w] in (" ", SPACE) and text[w - 1] not in (" ", SPACE))
        self.left = next(cuts, None)
        self.right = self.left and next(w for w in range(hi - 1, lo - 1, -1) if text[w] in (" ", SPACE) and text[w - 1] not in (" ", SPACE))

    def _enters(self, a: tuple[int, int], begin: int, tokens) -> bool:
        return self.first or bool(tokens) and self.m.follows(self.text, a, (tokens[0][0] + begin, tokens[0][1] + begin))

    def _leaves(self, b: tuple[int, int], begin: int, tokens) -> bool:
        return self.last or bool(tokens) and (tokens[-1][0] + begin, tokens[-1][1] + begin) == b

    def matrix(self) -> np.ndarray:
        """Weights from every entry to every exit: 0 where a path leads, else minus infinity."""
        if self.left is not None:
            ins = [self._enters(a, a[1], self.m.spans(self.text[a[1] : self.left])[1]) for a in self.entries]
            outs = [self._leaves(b, self.right, self.m.spans(self.text[self.right : b[1]])[1]) for b in self.exits]
            return np.where(np.outer(ins, outs), 0.0, NO_PATH)
        out = np.full((len(self.entries), len(self.exits)), NO_PATH)
        for e in {a[1] for a in self.entries}:
            for f in {b[1] for b in self.exits}:
                tokens = self.m.spans(self.text[e:f])[1]
                for i, a in enumerate(self.entries):
                    for j, b in enumerate(self.exits):
                        if a[1] == e and b[1] == f and self._enters(a, e, tokens) and self._leaves(b, e, tokens):
                            out[i, j] = 0.0
        return out

    def trace(self, k: int, l: int) -> list[int]:
        """Ids after entry state k, up to and with exit state l."""
        a, b = self.entries[k], self.exits[l]
        if self.left is None:
            return self.m.part.encode(self.text[a[1] : b[1]])
        e = self.m.part.encode
        return e(self.text[a[1] : self.left]) + e(self.text[self.left : self.right]) + e(self.text[self.right : b[1]])


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def settle(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) of each chunk on the path of weight 0 through all of them.

    The product is associative; forward products from the start and backward products from the end meet at each boundary.
    """
    n = len(matrices)
    ahead, back = [np.zeros((1, 1))], [np.zeros((1, 1))]
    for m in matrices:
        ahead.append(max_plus(ahead[-1], m))
    for m in reversed(matrices):
        back.append(max_plus(m, back[-1]))
    at = [int((ahead[k][0] + back[n - k][:, 0]).argmax()) for k in range(n + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def cut_chunks(text: str, size: int, reach: int) -> list[tuple[str, int, int, bool, bool]]:
    """Chunks of a text, with the leading space that the library adds, as arguments of :class:`Chunk`."""
    t = " " + text
    edges = [*range(0, len(t) - 4 * reach, max(size, 4 * reach)), len(t)] if len(t) > 4 * reach else [0, len(t)]
    out = []
    for p, q in zip(edges[:-1], edges[1:], strict=True):
        lo = max(0, p - 2 * reach)
        out.append((t[lo : q + 2 * reach], p - lo, q - lo, p == 0, q == len(t)))
    return out


def encode_text(model: Pieces, text: str, size: int = CHUNK) -> list[int]:
    """The scan on one machine; what the distributed operator does chunk by chunk."""
    if not text:
        return []
    chunks = [Chunk(model, *c) for c in cut_chunks(text, size, model.reach)]
    return [i for c, (k, l) in zip(chunks, settle([c.matrix() for c in chunks]), strict=True) for i in c.trace(k, l)]


def encode(docs: DataFrame, model: str, size: int = CHUNK, back: bool = False) -> DataFrame:
    """All columns of ``docs`` with ids (array of int); a column of that name is replaced. With ``back`` also decoded, made
    from the ids where they are made, so that they need not travel once more.

    Null and empty texts have no ids. Rows that repeat are encoded alike, null ids are kept, other columns stay, whatever
    their names; an empty table gives an empty result. Texts of up to ``size`` characters are one chunk.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(file_bytes(model))
    docs = docs.drop("ids", *["decoded"] * back)
    long = F.coalesce(F.char_length("text"), F.lit(0)) > size
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)

    def short(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = pieces(shipped.value)
        for b in batches:
            ids = m.whole.encode([t or "" for t in b.column("text").to_pylist()], num_threads=1)
            b = b.append_column("ids", pa.array(ids, pa.list_(pa.int32())))
            yield b.append_column("decoded", pa.array(m.whole.decode(ids), pa.string())) if back else b

    few = docs.where(~long).mapInArrow(short, f"{fields}, ids array<int>" + ", decoded string" * back)
    giant = docs.where(long).select(F.struct("*").alias("row"), "text", F.sha2("text", 256).alias("h"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = pieces(shipped.value).reach
        for b in batches:
            for h, text in zip(b["h"], b["text"], strict=True):
                rows = [(h, k, *c) for k, c in enumerate(cut_chunks(text, size, reach))]
                yield pd.DataFrame(rows, columns=["h", "k", "text", "p", "q", "first", "last"])

    schema = "h string, k int, text string, p int, q int, first boolean, last boolean"
    chunks = giant.select("h", "text").dropDuplicates(["h"]).mapInPandas(cut, schema)
    chunks = stored(chunks, "pieces-chunks")
    spread = chunks.repartition(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "h", "k")

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(shipped.value)
        for b in batches:
            rows = []
            for r in b.itertuples():
                w = Chunk(m, r.text, r.p, r.q, r.first, r.last).matrix()
                rows.append((r.h, r.k, w.shape[0], w.shape[1], (w == 0).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["h", "k", "rows", "cols", "w"])

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        w = [np.where(np.frombuffer(x, np.uint8).reshape(r, c) == 1, 0.0, NO_PATH) for x, r, c in zip(g["w"], g["rows"], g["cols"], strict=True)]
        at = settle(w)
        return pd.DataFrame({"h": g["h"], "k": g["k"], "enter": [a for a, _ in at], "leave": [b for _, b in at]})

    matrices = spread.mapInPandas(transfer, "h string, k int, rows int, cols int, w binary")
    states = stored(matrices.groupBy("h").applyInPandas(join, "h string, k int, enter int, leave int"), "pieces-states")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(shipped.value)
        for b in batches:
            ids = [Chunk(m, r.text, r.p, r.q, r.first, r.last).trace(r.enter, r.leave) for r in b.itertuples()]
            yield pd.DataFrame({"h": b["h"], "k": b["k"], "ids": ids})

    traced = chunks.join(states, ["h", "k"]).mapInPandas(trace, "h string, k int, ids array<int>")
    whole = traced.groupBy("h").agg(F.flatten(F.sort_array(F.collect_list(F.struct("k", "ids")))["ids"]).alias("ids"))
    many = giant.join(whole, "h").select("row.*", "ids")
    many = decode(many, model) if back else many
    return few.unionByName(many.select(*few.columns))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """All columns of ``encoded`` with decoded (string) made from ids; null ids give an empty text."""
    small_batches(encoded.sparkSession)
    shipped = encoded.sparkSession.sparkContext.broadcast(file_bytes(model))
    encoded = encoded.drop("decoded")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in encoded.schema)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = pieces(shipped.value).whole
        for b in batches:
            texts = m.decode([x or [] for x in b.column("ids").to_pylist()])
            yield b.append_column("decoded", pa.array(texts, pa.string()))

    return encoded.mapInArrow(scan, f"{fields}, decoded string")
