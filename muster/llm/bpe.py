"""Byte-level BPE: encoding and decoding by DuckDB queries inside each partition.

A text is cut by the tokenizer's pattern.  Each distinct piece is coded once: its bytes are token-position
rows, which a recursive query joins to the merge table; in every round the pair of least rank in each piece is
contracted, the leftmost first, until no piece holds a pair that merges.  Where no token of lower rank begins or ends
with the merged token, contracting it can make no pair that goes before it, so all its places in a piece are taken in
one round (in a run of one token, every other pair from the left); otherwise only the leftmost is.

Decoding joins the positions of the ids to the vocabulary and puts the bytes together by ordered aggregation.

Null and empty texts have no tokens.  Ids that are null or not in the vocabulary are an error in decoding.  Pieces
already coded are kept for the rest of a partition, up to ``MEMO`` of them, and texts are taken ``BATCH`` bytes at a
time, which bounds a worker's memory; nothing is shuffled, so a lost executor costs its own partitions only.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import text_batches, texts

MEMO = 400_000
BATCH = 2 << 20
MEMORY = "200MB"
#: White space before a blank or line end, or the byte that marks a text's first unit.
DOUBLE = re.compile(
    rb"(?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[ \n]|\x01"
)

#: Fixed value: the pattern that cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces of at most SHORT bytes: one round contracts the leftmost pair of least rank of every piece.
SHORT = 60
CODE_SHORT = """
WITH RECURSIVE coded AS (
  SELECT piece, ids, len(ids) AS n FROM fresh
  UNION ALL
  SELECT c.piece, c.ids[:b.best % 64] || [(b.best // 64)::INTEGER] || c.ids[b.best % 64 + 3:], n - 1
  FROM (
    SELECT p.piece, min(m.merged::BIGINT * 64 + p.pos) AS best
    FROM (
      SELECT piece, unnest(ids) AS tok, unnest(ids[2:]) AS next, generate_subscripts(ids, 1) - 1 AS pos FROM coded
    ) p
    JOIN merges m ON p.tok::BIGINT * 1048576 + p.next = m.pair
    GROUP BY p.piece
  ) b JOIN coded c ON c.piece = b.piece
)
SELECT piece, arg_min(ids, n) AS ids FROM coded GROUP BY piece
"""

#: Longer pieces: all places of the pair at once where that is the same, and only the last state is kept.
CODE_LONG = """
WITH RECURSIVE coded(piece, ids) USING KEY (piece) AS (
  SELECT piece, ids FROM fresh
  UNION
  SELECT piece, list(tok ORDER BY pos)
  FROM (
    WITH places AS (
      SELECT piece, unnest(ids) AS tok, unnest(list_append(ids[2:], -1)) AS next, generate_subscripts(ids, 1) AS pos
      FROM coded
    ), pairs AS (
      SELECT p.piece, p.pos, p.tok, m.merged
      FROM places p LEFT JOIN merges m ON p.tok::BIGINT * 1048576 + p.next = m.pair
    ), best AS (
      SELECT b.piece, b.merged, b.first, t.many
      FROM (
        SELECT piece, min(merged) AS merged, arg_min(pos, (merged, pos)) AS first
        FROM pairs WHERE merged IS NOT NULL GROUP BY piece
      ) b JOIN traits t ON b.merged = t.id
    ), hits AS (
      SELECT p.piece, p.pos, p.merged, p.pos - row_number() OVER (PARTITION BY p.piece ORDER BY p.pos) AS run
      FROM pairs p JOIN best b ON p.piece = b.piece AND p.merged = b.merged AND (b.many OR p.pos = b.first)
    ), taken AS (
      SELECT piece, pos, merged FROM hits
      QUALIFY row_number() OVER (PARTITION BY piece, run ORDER BY pos) % 2 = 1
    )
    SELECT p.piece, p.pos, coalesce(t.merged, p.tok) AS tok
    FROM pairs p JOIN best b ON p.piece = b.piece
    LEFT JOIN taken t ON p.piece = t.piece AND p.pos = t.pos
    LEFT JOIN taken gone ON p.piece = gone.piece AND p.pos = gone.pos + 1
    WHERE gone.piece IS NULL
  )
  GROUP BY piece
)
SELECT piece, ids FROM coded
"""

#: Rows in the order of their positions; one thread, so the aggregate takes them in that order.
DECODE = """
SELECT doc, string_agg(hex, '') AS hex, count(hex) AS known, count(*) AS n
FROM (SELECT p.doc, p.pos, v.hex FROM places p LEFT JOIN vocabulary v ON p.id = v.id ORDER BY p.pos)
GROUP BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file next to the program; a vocabulary has some ten thousand short entries."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Coder:
    """One DuckDB connection with the merge table, and the pieces already coded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.cut = regex.compile(pattern).findall
        self.ranks, self.pieces, self.units = ranks, {}, {}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        pairs, merged = [], []
        early = set()  # tokens that begin or end a token of lower rank
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None:
                    pairs.append(a << 20 | b)
                    merged.append(rank)
                early.update(x for x in (a, b) if x is not None and x > rank)
        ids = list(ranks.values())
        self._keep("merges", {"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())})
        self._keep("traits", {"id": pa.array(ids, pa.int32()), "many": pa.array([i not in early for i in ids])})
        self._keep("vocabulary", {"id": pa.array(ids, pa.int32()), "hex": pa.array([t.hex() for t in ranks])})

    def _keep(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.con.register("source", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM source")
        self.con.unregister("source")

    def _query(self, sql: str, name: str, source: pa.Table) -> pa.Table:
        self.con.register(name, source)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _merge(self, sql: str, part: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit numbers."""
        ends = np.cumsum([0, *map(len, part)], dtype=np.int32)
        ids = self.byte[np.frombuffer(b"".join(part), np.uint8)]
        fresh = pa.table({
            "piece": np.arange(len(part), dtype=np.int32), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
        })
        done = self._query(sql, "fresh", fresh)
        lists = done["ids"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        packed = lists.values.to_numpy().astype("<u4").tobytes()
        out = [b""] * len(part)
        for at, a, b in zip(done["piece"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            out[at] = packed[4 * a : 4 * b]
        return out

    def _code(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the memo; a piece that is a token as it stands needs no merge."""
        waiting: dict[str, list[tuple[str, bytes]]] = {CODE_SHORT: [], CODE_LONG: []}
        for piece in pieces:
            raw = piece.encode()
            known = self.ranks.get(raw)
            if known is not None:
                self.pieces[piece] = known.to_bytes(4, "little")
            else:
                waiting[CODE_SHORT if len(raw) <= SHORT else CODE_LONG].append((piece, raw))
        for sql, todo in waiting.items():
            start = 0
            while start < len(todo):
                end, size = start, 0
                while end < len(todo) and (end == start or size + len(todo[end][1]) <= 1 << 19):
                    size += len(todo[end][1])
                    end += 1
                coded = self._merge(sql, [raw for _, raw in todo[start:end]])
                self.pieces.update(zip([piece for piece, _ in todo[start:end]], coded, strict=True))
                start = end

    def _units(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units, from the memo or by cutting and merging the new ones."""
        coded = list(map(self.units.get, units))
        parts = {}
        for unit, got in zip(units, coded, strict=True):
            if got is None:
                alone = unit[1:] if unit[:1] == b"\x01" else unit if unit[:1] == b"\n" else b" " + unit
                parts[unit] = self.cut(alone.decode())
        self._code(set().union(*parts.values()) - self.pieces.keys())
        self.units.update((u, b"".join([self.pieces[p] for p in pieces])) for u, pieces in parts.items())
        return [self.units[u] if got is None else got for u, got in zip(units, coded, strict=True)]

    def encode(self, values: list[bytes]) -> list[bytes]:
        """The ids of each text.

        A piece ends before a blank or line end that follows no other white space, so texts are first split there
        into units, the first marked by a byte 1; the pattern cuts each distinct unit by itself.  Texts with white
        space before a blank or line end are cut whole.
        """
        import pyarrow.compute as pc

        if len(self.units) > MEMO or len(self.pieces) > MEMO:
            self.forget()
        out = [b""] * len(values)
        whole = {at for at, v in enumerate(values) if DOUBLE.search(v)}
        for at in whole:
            pieces = self.cut(values[at].decode())
            self._code(set(pieces) - self.pieces.keys())
            out[at] = b"".join([self.pieces[p] for p in pieces])
        plain = [at for at in range(len(values)) if at not in whole]
        if plain:
            marked = pa.array([b"\x01" + values[at].replace(b"\n", b" \n") for at in plain], pa.large_binary())
            lists = pc.split_pattern(marked, b" ")
            units = lists.values.dictionary_encode()
            ids = pa.array(self._units(units.dictionary.to_pylist()), pa.large_binary()).take(units.indices)
            ends = np.frombuffer(ids.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist()
            packed = memoryview(ids.buffers()[2])
            for at, a, b in zip(plain, ends[:-1], ends[1:], strict=True):
                out[at] = bytes(packed[a:b])
        return out

    def forget(self) -> None:
        """Give the memo's memory back: a worker that waits for its next task shares the executor with others."""
        self.units.clear()
        self.pieces.clear()

    def decode(self, coded: list[bytes]) -> list[bytes]:
        flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(coded), dtype=np.int32), [len(c) // 4 for c in coded])
        places = pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int32), "id": flat})
        done = self._query(DECODE, "places", places)
        if done["known"].to_pylist() != done["n"].to_pylist():
            raise ValueError("ids that are not in the vocabulary")
        out = [b""] * len(coded)
        for at, text in zip(done["doc"].to_pylist(), done["hex"].to_pylist(), strict=True):
            out[at] = bytes.fromhex(text)
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """The vocabulary and merge table, kept by a worker from task to task."""
    return Coder(load_ranks(path), pattern)


def code_documents(
    df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: the ids as little-endian 32-bit numbers, and the bytes decoded from them.

    ``ranks_path`` is a rank file present on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(ranks_path, pattern)
        for ids, values in text_batches(batches, BATCH):
            coded = made.encode(values)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary()),
                    pa.array(made.decode(coded), pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )
        made.forget()

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def decode_ids(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` from ids packed as ``code_documents`` packs them; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(ranks_path, PATTERN)
        for ids, values in text_batches(batches, BATCH):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(made.decode(values), pa.binary())], names=["doc_id", "decoded"]
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, decoded binary")
