"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers and what follows up to the next marker.
When no piece of the model holds a marker after another character, merges
cannot cross chunks, so each distinct chunk is segmented once and documents are
put together from the table by position.  A model whose pieces do cross is
encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

MARK = "▁"

#: Bytes that a generation of a worker's table may take, and the longest chunk kept in it.
TABLE_BYTES, CHUNK_CHARS = 24 << 20, 48
#: What an entry takes beside its characters (two dictionary slots, a tuple, three strings).
ENTRY_BYTES = 330
#: Characters of a long text that are cut into chunks at a time, and of short texts looked up together.
BLOCK, GROUP = 1 << 16, 1 << 16


class ChunkTable:
    """Ids, their decimal text and the decoded text of distinct chunks.

    The table has two generations.  What a text needs comes from the younger
    one, or is taken over from the older; when the younger is full it becomes
    the older one.  So chunks in use stay, others are forgotten, and the bytes
    are bounded.  Long chunks are never kept; they are segmented once a block.
    """

    def __init__(self, model: bytes, table_bytes: int = TABLE_BYTES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limit = table_bytes
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.bytes = 0
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        crosses = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # the model must also keep spaces as they are and put one marker in front
        probe = "".join(self.model.encode(" a  b", out_type=str))
        self.whole = crosses or probe != f"{MARK}{MARK}a{MARK}{MARK}b" or not self._plain_normaliser()
        self.split = re.compile(r" *[^ ]+| +").findall
        self.edge = re.compile(r"(?<=[^ ]) ").search

    def _plain_normaliser(self) -> bool:
        """Characters that other normalisers would change come through unchanged."""
        probe = "\uff21\u00bd\u2460e\u0301\u00a0x\ty\nz\u3000\u200b"
        try:
            return self.model.normalize(probe) == MARK + probe
        except Exception:
            return False

    def _segment(self, chunks: list[str]) -> dict[str, tuple[int, str, str]]:
        """Entries of distinct chunks that no generation has."""
        # a chunk begins with a marker, which encode() puts back in front of the rest
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        ids = [x if len(c) > 1 else [self.model.piece_to_id(MARK)] for c, x in zip(chunks, ids)]
        decoded = self.model.decode(ids, num_threads=1)
        return {c: (len(x), str(x)[1:-1].replace(" ", ""), d) for c, x, d in zip(chunks, ids, decoded)}

    def look_up(self, lists: list[list[str]]) -> list[list[tuple[int, str, str]]]:
        """Entries of each list of chunks; what is missing is segmented once for all lists."""
        missing = set().union(*lists).difference(self.young)
        found = {c: e for c in missing if (e := self.old.get(c)) is not None} if self.old else {}
        if fresh := [c for c in missing if c not in found]:
            found |= self._segment(fresh)
        self.young |= found
        entries = [list(map(self.young.__getitem__, chunks)) for chunks in lists]
        for c, e in found.items():
            if len(c) > CHUNK_CHARS:
                del self.young[c]
            else:
                self.bytes += ENTRY_BYTES + len(c) + len(e[1]) + len(e[2])
        if self.bytes > self.limit:
            self.old, self.young, self.bytes = self.young, {}, 0
        return entries

    def cuts(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text in order, a block at a time; blocks end at the first space of a run."""
        marked = " " + text.replace(MARK, " ")
        at = 0
        while at < len(marked):
            cut = self.edge(marked, at + BLOCK)
            end = cut.start() if cut else len(marked)
            yield self.split(marked, at, end)
            at = end

    def blocks(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """Entries of a text's chunks in order, a block at a time."""
        for chunks in self.cuts(text):
            yield self.look_up([chunks])[0]

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text)."""
        if self.whole:
            ids = self.model.encode(text, num_threads=1)
            return len(ids), ",".join(map(str, ids)), self.model.decode(ids)
        entries = [e for block in self.blocks(text) for e in block] if text else []
        # decode() drops the marker in front of the first piece only
        return sum(e[0] for e in entries), ",".join(e[1] for e in entries), " ".join(e[2] for e in entries)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text.

        Short texts share one look-up of their chunks; long ones take one a block.
        """
        out: list = [None] * len(texts)
        if self.whole:
            return [(n, sha(ids), sha(decoded)) for n, ids, decoded in map(self.encode, texts)]
        short = [i for i, t in enumerate(texts) if t and len(t) < BLOCK]
        at = 0
        while at < len(short):
            end, chars = at, 0
            while end < len(short) and chars < GROUP:
                chars += len(texts[short[end]])
                end += 1
            own = short[at:end]
            for i, entries in zip(own, self.look_up([self.split(" " + texts[i].replace(MARK, " ")) for i in own])):
                n, ids, decoded = zip(*entries)
                out[i] = (sum(n), sha(",".join(ids)), sha(" ".join(decoded)))
            at = end
        for i, text in enumerate(texts):
            if out[i] is None:
                out[i] = self._digest_blocks(text)
        return out

    def _digest_blocks(self, text: str) -> tuple[int, str, str]:
        total, ids_sum, decoded_sum = 0, hashlib.sha256(), hashlib.sha256()
        for block in self.blocks(text) if text else ():
            if total:
                ids_sum.update(b",")
                decoded_sum.update(b" ")
            n, ids, decoded = zip(*block)
            total += sum(n)
            ids_sum.update(",".join(ids).encode())
            decoded_sum.update(" ".join(decoded).encode("utf-8", "surrogatepass"))
        return total, ids_sum.hexdigest(), decoded_sum.hexdigest()

    def ids(self, text: str) -> list[int]:
        joined = self.encode(text)[1]
        return [int(x) for x in joined.split(",")] if joined else []


def sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids, decoded`` on request).

    Null texts count as empty: no ids, and hashes of the empty string.  Texts of
    any length are taken whole, a block at a time.  Repeated rows give repeated
    results, an empty table an empty one; extra columns are ignored.  Each
    partition has a table of its distinct chunks, bounded in bytes; nothing is
    shuffled, so a lost executor costs only its own partitions.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        table = ChunkTable(model, table_bytes)
        for large in batches:
            for at in range(0, large.num_rows, 500):
                batch = large.slice(at, 500)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                if not with_ids:
                    found = table.digests(texts)
                    columns = [batch.column(0), *(pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    continue
                full = [table.encode(t) for t in texts]
                columns = [batch.column(0), pa.array([x[0] for x in full], pa.int64())]
                columns += [pa.array([sha(x[i]) for x in full], pa.string()) for i in (1, 2)]
                columns += [pa.array([[int(i) for i in x[1].split(",")] if x[1] else [] for x in full], pa.list_(pa.int32())), pa.array([x[2] for x in full], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return rows.mapInArrow(work, schema)
