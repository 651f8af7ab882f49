"""Operator 1: byte-level BPE encoding and decoding with DuckDB inside each partition.

Texts are cut into pieces by the tokenizer's pattern. Each distinct piece of a run of documents becomes a row of two
lists: its tokens, at first its bytes, and the tokens that neighbours would make. A recursive query contracts, in each
piece, the leftmost pair of least rank and joins the new token and its two neighbours with the merge table, until no pair
of the piece is in the table. An ordered aggregation of the tokens' bytes decodes.

A piece of over BLOCK bytes is cut into blocks, which are merged side by side, and neighbours are joined in pairs: the
last tokens of one and the first of the other are decoded and merged anew. A sequence is the encoding of its bytes if and
only if every two neighbours are the encoding of theirs (the first merge across a border would occur for the two alone as
well). So where the new tokens begin and end with the old ones, the joined sequence is the encoding; else more tokens are
taken. Where over SHORT bytes at a border would change (a run of one letter that other letters shift, say), the piece is
merged from left to right in windows of WINDOW bytes, each begun some settled tokens back, with a heap of pairs instead of
a query: the same contraction, a step for each pair and not for each state. A long piece thus costs about as much as its
length, whatever it holds.

Nothing is shuffled; the merge table (bounded by the vocabulary) is the only thing sent to executors. Memory is bounded
by PIECES_KEPT pieces and RUNS_KEPT runs, by QUERY_TOKENS tokens of a query (all its states), by PART_CHARS characters of
texts that are encoded together and by the longest text.

Defined results: a null or empty text has no tokens (hashes of the empty string); repeated rows give repeated rows;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common

#: Pieces whose tokens a Python worker remembers, and runs of tokens whose bytes; bytes of pieces given to one query, and
#: tokens of all states of a query.
PIECES_KEPT, RUNS_KEPT = 1_000_000, 600_000
QUERY_BYTES = 400_000
QUERY_TOKENS = 5_000_000
#: Characters of texts whose new pieces are merged together (a step of a query costs the same for few pieces and for many);
#: each text counts as TEXT_CHARS more.
PART_CHARS, TEXT_CHARS = 4_000_000, 100

#: Bytes of a block, tokens on either side of a border that are merged anew at first, and bytes of them at the most.
BLOCK, BORDER, SHORT = 64, 4, 128
#: Bytes that one heap holds, and settled tokens before them that are merged anew at first.
WINDOW, BACK = 65_536, 8

#: Stands for the token of a pair that is not in the merge table.
NONE = 2**31 - 1

#: pairs[i] is the token of ids[i - 1] and ids[i]; with NONE at both ends it is one longer than ids. The first place of the
#: least token is the leftmost pair of least rank.
MERGE = f"""
WITH RECURSIVE state(w, ids, pairs, least) AS (
    SELECT w, ids, pairs, list_min(pairs) FROM pieces
  UNION ALL
    SELECT w, ids, pairs, list_min(pairs)
    FROM (
        SELECT s.w, s.ids[:s.i - 2] || [s.least] || s.ids[s.i + 1:] AS ids,
               s.pairs[:s.i - 2] || [coalesce(a.token, {NONE}), coalesce(b.token, {NONE})] || s.pairs[s.i + 2:] AS pairs
        FROM (SELECT *, list_position(pairs, least) AS i FROM state WHERE least < {NONE}) s
        LEFT JOIN merges a ON a.pair = ((s.ids[s.i - 2]::BIGINT << 32) | s.least)
        LEFT JOIN merges b ON b.pair = ((s.least::BIGINT << 32) | s.ids[s.i + 1]))
)
SELECT array_to_string(ids, ' ') AS ids FROM state WHERE least = {NONE} ORDER BY w
"""

#: The tokens of many sequences in one order, with a blank between two sequences.
DECODE = "SELECT string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM sequences t JOIN vocabulary v ON v.id = t.id"
BLANK = -1


class Ranks:
    """A rank file (lines: base64 of a token's bytes, rank) as arrays: the vocabulary and its merge table."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            raw = file.read()
        self.digest = hashlib.sha256(raw).hexdigest()
        self.token_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        of = self.token_of
        self.merges = [(of[token[:at]], of[token[at:]], rank) for token, rank in of.items() for at in range(1, len(token)) if token[:at] in of and token[at:] in of]
        self.byte_ids = [of[bytes([b])] for b in range(256)]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: Ranks, pattern: str) -> None:
        import duckdb
        import numpy as np

        self.cut = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "600MB", "temp_directory": ""})
        self.byte_ids = ranks.byte_ids
        self.bytes_of = {rank: token for token, rank in ranks.token_of.items()}
        pair, token = zip(*((a << 32 | b, rank) for a, b, rank in ranks.merges), strict=True)
        self.merges = ranks.merges
        self.token_of_pair: dict[int, int] = {}
        merges = pa.table({"pair": pa.array(pair, pa.int64()), "token": pa.array(token, pa.int32())})
        hex_of = {BLANK: " "} | {rank: token.hex() for token, rank in ranks.token_of.items()}
        vocabulary = pa.table({"id": pa.array(hex_of, pa.int32()), "hex": pa.array(hex_of.values(), pa.string())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        #: Tokens of two neighbouring bytes; 256 stands for the end of a piece.
        self.byte_pairs = np.full((257, 257), NONE, np.int32)
        byte_of = {i: b for b, i in enumerate(ranks.byte_ids)}
        for a, b, rank in ranks.merges:
            if a in byte_of and b in byte_of:
                self.byte_pairs[byte_of[a], byte_of[b]] = rank
        self.known: dict[str, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        self.trips: dict[str, tuple[bytes, bytes]] = {}

    def pieces(self, text: str | None) -> list[str]:
        return self.cut(text) if text else []

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces that are not known yet."""
        if len(self.known) > PIECES_KEPT:
            self.known.clear()
        new = list(pieces)
        self.known.update(zip(new, self._encode(new), strict=True))

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Decimal ids of pieces, joined by one space."""
        raws = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
        long = [raw for raw in raws if len(raw) > SHORT]
        merged = iter(self.merge([raw for raw in raws if len(raw) <= SHORT] if long else raws))
        merged_long = iter(self.merge_long(long))
        return [next(merged) if len(raw) <= SHORT else " ".join(map(str, next(merged_long))).encode() for raw in raws] if long else list(merged)

    def merge(self, raws: list[bytes]) -> list[bytes]:
        """Decimal ids of byte strings of up to SHORT bytes, in queries of a bounded number of tokens."""
        out: list[bytes] = []
        part, size, tokens = [], 0, 0
        for raw in raws:
            part.append(raw)
            size += len(raw)
            tokens += len(raw) * (len(raw) + 1) // 2  # a token less a step
            if size >= QUERY_BYTES or tokens >= QUERY_TOKENS:
                out += self._query(part)
                part, size, tokens = [], 0, 0
        return out + (self._query(part) if part else [])

    def _merged(self, raws: list[bytes]) -> list[list[int]]:
        """Ids of byte strings, each different one merged once."""
        different = list(dict.fromkeys(raws))
        found = dict(zip(different, self.merge(different), strict=True))
        return [list(map(int, found[raw].split())) for raw in raws]

    def merge_long(self, raws: list[bytes]) -> list[list[int]]:
        """Ids of long byte strings, by blocks that are joined in pairs, side by side for all strings."""
        blocks = [[raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)] for raw in raws]
        merged = iter(self._merged([block for own in blocks for block in own]))
        parts = [[next(merged) for _ in own] for own in blocks]
        while open_ := [(w, k) for w, own in enumerate(parts) for k in range(len(own) // 2)]:
            joined: dict[tuple[int, int], list[int]] = {}
            border = BORDER
            while open_:
                ends = [(parts[w][2 * k][-border:], parts[w][2 * k + 1][:border]) for w, k in open_]
                again = [self.bytes(left + right) for left, right in ends]
                for w in {w for (w, _), raw in zip(open_, again, strict=True) if len(raw) > SHORT and border > BORDER}:
                    parts[w] = [self.merge_windows(raws[w])]
                rest = [(at, end, raw) for at, end, raw in zip(open_, ends, again, strict=True) if len(parts[at[0]]) > 1]
                open_ = []
                for (w, k), (left, right), new in zip([at for at, *_ in rest], [end for _, end, _ in rest], self._merged([raw for *_, raw in rest]), strict=True):
                    a, b = parts[w][2 * k], parts[w][2 * k + 1]
                    if (len(a) <= border or new[0] == left[0]) and (len(b) <= border or new[-1] == right[-1]):
                        joined[w, k] = a[:-border] + new + b[border:]
                    else:
                        open_.append((w, k))
                border *= 2
            for w, own in enumerate(parts):
                if len(own) > 1:
                    parts[w] = [joined[w, k] for k in range(len(own) // 2)] + own[2 * (len(own) // 2) :]
        return [own[0] for own in parts]

    def bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def merge_windows(self, raw: bytes) -> list[int]:
        """Ids of one long byte string, from left to right."""
        done = self.merge_heap(raw[:WINDOW])
        for at in range(WINDOW, len(raw), WINDOW):
            more, back = raw[at : at + WINDOW], BACK
            while True:
                old = done[-back:]
                new = self.merge_heap(self.bytes(old) + more)
                if len(done) <= back or new[0] == old[0]:
                    break
                back *= 2
            done[-back:] = new
        return done

    def merge_heap(self, raw: bytes) -> list[int]:
        """Contract the leftmost pair of least rank until none is left: a heap of (token, place), tokens linked by place."""
        if not self.token_of_pair:
            self.token_of_pair = {a << 32 | b: token for a, b, token in self.merges}
        find = self.token_of_pair.get
        n = len(raw)
        ids = [self.byte_ids[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [token << 32 | k for k in range(n - 1) if (token := find(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            token, k = divmod(heapq.heappop(heap), 1 << 32)
            right = after[k]
            if ids[k] < 0 or right >= n or find(ids[k] << 32 | ids[right]) != token:
                continue  # one of the two is part of another token by now
            ids[k], ids[right] = token, -1
            end = after[k] = after[right]
            if end < n:
                before[end] = k
                if (new := find(token << 32 | ids[end])) is not None:
                    heapq.heappush(heap, new << 32 | k)
            start = before[k]
            if start >= 0 and (new := find(ids[start] << 32 | token)) is not None:
                heapq.heappush(heap, new << 32 | start)
        return [i for i in ids if i >= 0]

    def _query(self, raws: list[bytes]) -> list[bytes]:
        import numpy as np

        flat = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([0, *map(len, raws)], dtype=np.int32)
        number = np.arange(len(raws) + 1, dtype=np.int32)
        spaced = np.insert(flat.astype(np.int32), ends, 256)
        rows = pa.table({
            "w": number[:-1],
            "ids": pa.ListArray.from_arrays(ends, np.asarray(self.byte_ids, np.int32)[flat]),
            "pairs": pa.ListArray.from_arrays(ends + number, self.byte_pairs[spaced[:-1], spaced[1:]]),
        })
        self.db.register("pieces", rows)
        found = self.db.sql(MERGE).to_arrow_table()
        self.db.unregister("pieces")
        return [ids.encode() for ids in found.column("ids").to_pylist()]

    def encode(self, texts: list[str | None]) -> list[list[bytes]]:
        """For each text the tokens of its pieces: decimal ids joined by one space."""
        cut = [self.pieces(t) for t in texts]
        given = set().union(*cut)
        if fresh := given.difference(self.known):
            self.learn(sorted(given if len(self.known) > PIECES_KEPT else fresh))
        return [list(map(self.known.__getitem__, pieces)) for pieces in cut]

    def decode(self, sequences: list[list[bytes]]) -> list[bytes]:
        """The bytes of token sequences, each given as runs of decimal ids; each distinct run is aggregated once."""
        if len(self.decoded) > RUNS_KEPT:
            self.decoded.clear()
        fresh = list(set().union(*sequences).difference(self.decoded))
        self.decoded.update(zip(fresh, self._decode(fresh), strict=True))
        return [b"".join(map(self.decoded.__getitem__, s)) for s in sequences]

    def _decode(self, runs: list[bytes]) -> list[bytes]:
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(runs), 20_000):
            ids = np.array((b" %d " % BLANK).join(runs[at : at + 20_000]).split(), np.int32)
            self.db.register("sequences", pa.table({"pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            text = self.db.sql(DECODE).to_arrow_table().column("hex")[0].as_py()
            self.db.unregister("sequences")
            out += map(bytes.fromhex, text.split(" "))
        return out

    def round_trip(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its decimal ids joined by one space, and the bytes that they decode to; each distinct piece is decoded once."""
        cut = [self.pieces(t) for t in texts]
        given = set().union(*cut)
        fresh = list(given.difference(self.trips))
        if fresh and len(self.trips) > PIECES_KEPT:
            self.trips.clear()
            fresh = list(given)
        if fresh:
            runs = self._encode(fresh)
            self.trips.update(zip(fresh, zip(runs, self._decode(runs), strict=True), strict=True))
        for pieces in cut:
            ids, raw = zip(*map(self.trips.__getitem__, pieces), strict=True) if pieces else ((), ())
            yield b" ".join(ids), b"".join(raw)


_codecs: dict[tuple, Codec] = {}


def codec_of(ranks, pattern: str) -> Codec:
    """The worker's codec: tasks that follow one another in a Python worker share what it has learnt."""
    vocabulary = ranks.value
    key = (vocabulary.digest, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of whole texts: (id_column, ids array<int>), one row for each row of docs."""
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(ranks_path))
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        for part in common.rows(batches, "key", "text", step=64):
            ids = [[int(i) for run in runs for i in run.split()] for runs in codec.encode([t for _, t in part])]
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "ids": pa.array(ids, pa.list_(pa.int32()))})

    picked = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, f"key {kind.simpleString()}, ids array<int>").withColumnRenamed("key", id_column)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Bytes of token ids: (id_column, bytes binary). Null ids give null; an id outside the vocabulary is an error."""
    ranks = tokens.sparkSession.sparkContext.broadcast(Ranks(ranks_path))
    kind = tokens.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        size = len(ranks.value.token_of)
        for part in common.rows(batches, "key", "ids", step=64):
            if any(not 0 <= i < size for _, ids in part for i in ids or ()):
                raise ValueError("a token id is not in the vocabulary")
            runs = [[b" ".join(b"%d" % i for i in ids[at : at + 4]) for at in range(0, len(ids), 4)] if ids else [] for _, ids in part]
            raw = [None if ids is None else b for (_, ids), b in zip(part, codec.decode(runs), strict=True)]
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "bytes": pa.array(raw, pa.binary())})

    picked = tokens.select(F.col(id_column).alias("key"), F.col(ids_column).alias("ids"))
    return picked.mapInArrow(run, f"key {kind.simpleString()}, bytes binary").withColumnRenamed("key", id_column)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Ids and texts in lists of about PART_CHARS characters."""
    part, size = [], 0
    for rows in common.rows(batches, "doc_id", "text", step=64):
        part += rows
        size += sum(len(text or "") + TEXT_CHARS for _, text in rows)
        if size >= PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part
    common.release()


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        for part in _parts(batches):
            out = []
            for (doc_id, _), (ids, raw) in zip(part, codec.round_trip([t for _, t in part]), strict=True):
                out.append((doc_id, ids.count(b" ") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))
            yield common.record_batch(DIGEST, out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
