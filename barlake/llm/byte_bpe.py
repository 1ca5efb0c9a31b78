"""Byte-level BPE: DuckDB recursive queries merge, ordered aggregation decodes, inside each Spark task.

A text is cut into chunks at blanks where the split pattern can never match across, each chunk into
pieces by the pattern. A task sends the pieces it has not met yet to an in-process DuckDB: rows of
(piece, position, token) join the merge table, and every recursion contracts each piece's leftmost
pair of least rank until none is left; where that pair cannot compete with another, its further places, which would be
the next ones, go in the same step. Decoding joins the token table with the ids of each document and strings the bytes together in
order. Pieces that have been met stay in a two-generation cache of bounded size. Texts and pieces of any length are taken
whole; memory follows the longest text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, tune

#: Chunks kept in each of the two cache generations of a Python worker.
CACHE = 300_000
#: Bytes of pieces in one recursive query, and tokens in one that decodes.
SLICE, TOKENS = 400_000, 400_000
#: A vocabulary file beyond this is not sent along with tasks.
MAX_VOCABULARY = 64 << 20

# A token is the character of its number plus SHIFT (past the surrogates), and a piece a string of them; its
# positions are unnested to rows, which join the merge table on two characters. A rank can belong to several pairs: alt numbers them,
# and last is LAST - alt where all places of the pair may go at once; alt and last add up to LAST if the rank stands for one such pair only.
SHIFT, LAST = 0xE000, 1023
_ENCODE = f"""
    with recursive t(word, s, live) using key (word) as (
        select word, s, true from start
        union
        select t.word,
               case when b.low is null then t.s
               when b.alt + b.last = {LAST} then replace(t.s, substr(t.s, b.low % 4294967296, 2), chr(cast(b.low // 4294967296 + {SHIFT} as integer)))
               else substr(t.s, 1, b.low % 4294967296 - 1) || chr(cast(b.low // 4294967296 + {SHIFT} as integer)) || substr(t.s, b.low % 4294967296 + 2) end,
               b.low is not null
        from t left join (
            select word, min(m.rank * 4294967296 + x.pos) as low, min(m.rank * {LAST + 1} + m.alt) % {LAST + 1} as alt, min(m.rank * {LAST + 1} + m.last) % {LAST + 1} as last
            from (select word, unnest(range(1, len(l))) as pos, unnest(l) as a, unnest(l[2:]) as b from (select word, string_split(s, '') as l from t where live)) x
            join merges m on m.pair = x.a || x.b group by word
        ) b on b.word = t.word
        where t.live
    )
    select word, s from t order by word
"""
_DECODE = """
    select word, string_agg(v.hex, '' order by r.pos) as hex
    from runs r join vocabulary v on v.tok = r.tok group by word order by word
"""
_codecs: dict[str, Codec] = {}


class Codec:
    """One vocabulary in one process."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.blanks = regex.compile(r"\s*\S+|\s+")
        self.doubled = regex.compile(r"\s ")
        pair, rank, alt = [], [], []
        below: dict[int, int] = {}  # the least rank of a pair that a token is part of
        for token, r in self.ranks.items():
            alike = 0
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pair.append(chr(SHIFT + a) + chr(SHIFT + b)), rank.append(r), alt.append(min(alike, LAST - 1))
                    alike += 1
                    for part in (a, b):
                        below[part] = min(below.get(part, r), r)
        # a token that could go on to a pair of no higher rank must do so before the pair's next place
        last = [LAST - x - (below.get(r, r + 1) <= r) for x, r in zip(alt, rank)]
        self.db = duckdb.connect()
        self.db.execute("set threads = 1")
        self._load("merges", {"pair": pair, "rank": np.array(rank, np.int64), "alt": np.array(alt, np.int64), "last": np.array(last, np.int64)})
        self._load("vocabulary", {"tok": list(self.ranks.values()), "hex": [t.hex() for t in self.ranks]})
        self.letters = {b: chr(SHIFT + self.ranks[bytes([b])]) for b in range(256)}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        todo, size = [], 0
        for k, piece in enumerate(pieces):
            if piece in self.ranks:
                out[k] = self.ranks[piece].to_bytes(4, "little")
            else:
                todo.append(k)
                size += len(piece)
                if size > SLICE:
                    self._encode_slice(pieces, todo, out)
                    todo, size = [], 0
        if todo:
            self._encode_slice(pieces, todo, out)
        return out

    def _encode_slice(self, pieces: list[bytes], todo: list[int], out: list[bytes]) -> None:
        letters = self.letters
        self._load("start", {"word": np.arange(len(todo)), "s": ["".join([letters[x] for x in pieces[k]]) for k in todo]})
        merged = self.db.sql(_ENCODE).to_arrow_table().column("s").to_pylist()
        ids = np.frombuffer("".join(merged).encode("utf-32-le"), "<u4") - np.uint32(SHIFT)
        data, at = ids.astype("<u4").tobytes(), 0
        for k, s in zip(todo, merged):
            out[k] = data[at : at + 4 * len(s)]
            at += 4 * len(s)

    def decode_runs(self, runs: list[bytes]) -> list[bytes]:
        """Bytes of each run of ids."""
        out: list[bytes] = []
        i = 0
        while i < len(runs):
            j, size = i, 0
            while j < len(runs) and (j == i or size + len(runs[j]) <= 4 * TOKENS):
                size += len(runs[j])
                j += 1
            lengths = np.array([len(r) // 4 for r in runs[i:j]])
            self._load("runs", {"word": np.repeat(np.arange(j - i), lengths), "pos": np.arange(lengths.sum()), "tok": np.frombuffer(b"".join(runs[i:j]), "<u4").astype(np.int64)})
            got = self.db.sql(_DECODE).to_arrow_table()
            texts = dict(zip(got.column("word").to_pylist(), got.column("hex").to_pylist()))
            out += [bytes.fromhex(texts.get(k, "")) for k in range(j - i)]
            i = j
        return out

    def chunks(self, text: str) -> list[str]:
        """The text in chunks that the pattern never matches across: cut before each blank after a non-blank."""
        if self.doubled.search(text):
            return self.blanks.findall(text)
        first, *rest = text.split(" ")
        return [x for x in (first, *[" " + x for x in rest]) if x]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Chunks of each text; afterwards both caches know them all."""
        cut = [self.chunks(t) for t in texts]
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        unknown = {}
        for chunks in cut:
            for c in chunks:
                if c not in new:
                    if c in old:
                        new[c] = old[c]
                    else:
                        unknown[c] = None
        if unknown:
            parts = [self.pattern.findall(c) for c in unknown]
            # a piece that is a known chunk by itself needs no query; the others become known that way too
            fresh = [p for p in dict.fromkeys(p for ps in parts for p in ps) if p not in new]
            for p in fresh:
                if p in old:
                    new[p] = old[p]
            fresh = [p for p in fresh if p not in new]
            new.update(zip(fresh, self.encode_pieces([p.encode() for p in fresh])))
            for c, ps in zip(unknown, parts):
                if len(ps) > 1:
                    new[c] = b"".join([new[p] for p in ps])
        return cut

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids (little-endian 32-bit integers) of each text, and the bytes that these ids decode to."""
        for i in range(0, len(texts), 256):
            runs = [b"".join([self.new[c] for c in chunks]) for chunks in self.learn(texts[i : i + 256])]
            yield from zip(runs, self.decode_runs(runs))


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """The process's codec of that vocabulary; a Python worker builds it once."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    """The rank file, read by the driver (its path is a parameter) and sent along with the tasks."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return data


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs' rows and columns with ids (binary: little-endian 32-bit), n_tokens and decoded (binary) added.

    Null text: empty. Repeated rows each get theirs; columns that bear an added name are replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens", "decoded")
    ranks_file = read_vocabulary(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = list(codec(ranks_file, pattern).encode([t or "" for t in batch.column("text").to_pylist()]))
        arrays = [pa.array([a for a, _ in got], pa.binary()), pa.array([len(a) // 4 for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "ids", "n_tokens", "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{fields}, ids binary, n_tokens long, decoded binary")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """ids' rows and columns with the text added that the column ids (binary) decodes to; null ids: null text.

    Bytes that are not UTF-8 become replacement characters.
    """
    tune(ids.sparkSession)
    ids = ids.drop("text")
    ranks_file = read_vocabulary(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = batch.column("ids").to_pylist()
        back = codec(ranks_file, pattern).decode_runs([r or b"" for r in runs])
        texts = pa.array([None if r is None else b.decode("utf-8", "replace") for r, b in zip(runs, back)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema)
    return arrow_map(ids, run, f"{fields}, text string")
