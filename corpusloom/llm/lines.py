"""Line deduplication by a deletion-neighbourhood join.

A line is its words. It is dropped if an earlier line, by (doc_id, row, line number) over the whole
corpus, has the same words or is one edit away. An edit replaces, adds or leaves out one unit: a word in lines of
``NEAR_WORDS`` words or more, a character (of the words joined by one space) in shorter lines of ``NEAR_CHARS`` characters or
more, which covers scripts without spaces. Still shorter lines have no near copies, only
equal ones; blank lines always stay.

1. Lines are numbered and hashed; equal lines are grouped with partial aggregation, and from here
   on a line is one row, however often it is repeated.
2. One edit leaves the first or the second half of the shorter line as it is. Halves are
   hashed, and lines that share a half with a different line are candidates; all others have
   no neighbour. This loses nothing and spares most lines the variants.
3. The texts are read once more for the words of the candidates, which set bits of a fixed bitmap. Candidates
   are numbered in their order, so that a line is one number in all that follows.
4. A candidate emits its variants: itself, and itself without each one of its units, as hashed
   keys. Lines that are equal without the unit at the same place are one replacement apart;
   a line that equals another without some unit is one addition apart. Every such group is
   answered by its earliest line, so a group costs its size, never its pairs.
5. Each is compared with its earliest neighbour, unit by unit, before it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import bounded, flagged, free_names, packed_bits, stage

NEAR_WORDS, NEAR_CHARS = 8, 20
#: Bits of the bitmap of candidates.
BITS = 1 << 24
_LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def _hash(data: bytes, salt: int = 0) -> int:
    """64 bits as a signed number."""
    value = xxhash.xxh3_64_intdigest(data, salt)
    return value - (1 << 64) if value >> 63 else value


def units(line: str, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> list[str] | None:
    """What an edit of a line (words joined by one space) changes one of: its words, its characters, or None if it has too few."""
    words = line.split(" ")
    if len(words) >= near_words:
        return words
    return list(line) if len(line) >= near_chars else None


def _half_keys(parts: list[str], by: str) -> list[int]:
    """Hashed halves by which this line meets every line one edit away: for its own number of units and one less as the shorter's."""
    n, keys = len(parts), []
    for shorter in (n - 1, n):
        half = shorter // 2
        size = f"{shorter}{by}"
        keys.append(_hash(f"{by.join(parts[:half])}\n<{size}".encode()))
        keys.append(_hash(f"{by.join(parts[n - (shorter - half):])}\n>{size}".encode()))
    return keys


def _joiner(line: str, near_words: int) -> str:
    return " " if line.count(" ") + 1 >= near_words else ""


def _keyed(docs: DataFrame, of: str, row: str) -> DataFrame:
    """docs with columns ``of`` and ``row``, which tell their rows apart: the id as a number that is never null, and a hash of the
    text or, of rows without an id, their number. Only the latter rows are staged, so that the number holds."""
    numbered = docs.withColumn(of, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    without = stage(numbered.where(F.col("doc_id").isNull()).withColumn(row, F.monotonically_increasing_id()), "rows-without-id")
    return numbered.where(F.col("doc_id").isNotNull()).withColumn(row, F.xxhash64("text")).unionByName(without)


def line_table(rows: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc_id, row, line, h1, h2, halves) of every line that has a word of rows (doc_id, row, text); halves are null where there are too few units."""
    schema = "doc_id long, row long, line int, h1 long, h2 long, halves array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            ids, of_rows, numbers, one, two, halves = [], [], [], [], [], []
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                for number, line in enumerate((text or "").encode().split(b"\n")):
                    words = line.split()
                    if not words:
                        continue
                    joined = b" ".join(words)
                    ids.append(doc_id)
                    of_rows.append(row)
                    numbers.append(number)
                    one.append(_hash(joined, 1))
                    two.append(_hash(joined, 2))
                    said = joined.decode()
                    parts = units(said, near_words, near_chars)
                    halves.append(parts and _half_keys(parts, _joiner(said, near_words)))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(of_rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(one, pa.int64()),
                pa.array(two, pa.int64()), pa.array(halves, pa.list_(pa.int64())),
            ], names=["doc_id", "row", "line", "h1", "h2", "halves"])

    return rows.mapInArrow(run, schema)


def _said(rows: DataFrame, bits: bytes) -> DataFrame:
    """(h1, h2, words) of lines of rows (text) whose h1 is flagged, each once a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(bits, np.uint8)
        for batch in bounded(batches, "text"):
            joined = list({b" ".join(line.split()) for text in batch.column("text").to_pylist() if text for line in text.encode().split(b"\n")})
            one = np.fromiter((_hash(x, 1) for x in joined), np.int64, len(joined))
            found = np.flatnonzero(flagged(packed, one.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(one[found]), pa.array([_hash(joined[i], 2) for i in found], pa.int64()), pa.array([joined[i].decode() for i in found], pa.string()),
            ], names=["h1", "h2", "words"])

    return rows.select("text").mapInArrow(run, "h1 long, h2 long, words string")


def variant_keys(parts: list[bytes]) -> np.ndarray:
    """Hash of the units, then of the units without the first, without the second, ...

    Polynomials of hashes, so a line of n units costs n steps whatever its length:
    what stands after a left-out unit moves up by one power, a multiplication by the inverse
    of the base. (Of hashes that collide the texts are compared in the end.)
    """
    n = len(parts)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
    upto = np.cumsum(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in parts), np.uint64, n) * power)
    before = np.concatenate([[np.uint64(0)], upto[:-1]])
    keys = np.concatenate([upto[-1:], before + (upto[-1] - upto) * _INVERSE])
    keys += np.concatenate([[np.uint64(n)], np.full(n, n - 1, np.uint64)]) * _LENGTH
    return (keys ^ (keys >> np.uint64(32))) * _LENGTH


def _variants(candidates: DataFrame, near_words: int, near_chars: int) -> DataFrame:
    """(ord, place, key) of candidates (ord, words): keys of the line itself (place -1) and of the line without each of its units (place of the unit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "words", 1 << 18):
            keys = []
            for line in batch.column("words").to_pylist():
                kind = np.uint64(len(_joiner(line, near_words)))
                keys.append(variant_keys([u.encode() for u in units(line, near_words, near_chars)]) + kind)
            sizes = np.array([len(k) for k in keys])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column("ord").to_numpy(), sizes)), pa.array((np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) - 1).astype(np.int32)),
                pa.array(np.concatenate(keys).view(np.int64)),
            ], names=["ord", "place", "key"])

    return candidates.select("ord", "words").mapInArrow(run, "ord long, place int, key long")


def one_edit_apart(x: list[str], y: list[str]) -> bool:
    """Whether two lists differ by at most one unit replaced, added or left out."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    same = 0
    while same < len(x) and x[same] == y[same]:
        same += 1
    return x[same + (len(x) == len(y)):] == y[same + 1:]


def _place() -> Column:
    return F.struct("doc_id", "row", "line")


def _near_lines(rows: DataFrame, distinct: DataFrame, near_words: int, near_chars: int) -> DataFrame:
    """(h1, h2) of lines that have an earlier line within one edit; ``distinct`` is (h1, h2, first, halves)."""
    # h1 alone tells lines apart well enough here: a collision only makes one more candidate
    halves = distinct.where(F.col("halves").isNotNull()).select("h1", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where(F.col("low") != F.col("high")).select("half")
    wanted = stage(halves.join(met, "half", "left_semi").select("h1").distinct(), "line-candidates")
    said = _said(rows, packed_bits(wanted, "h1", BITS)).groupBy("h1", "h2").agg(F.first("words").alias("words"))
    known = distinct.where(F.col("halves").isNotNull()).join(wanted, "h1", "left_semi").select("h1", "h2", "first")
    # numbered in the order of their first places
    ordered = known.join(said, ["h1", "h2"]).repartitionByRange("first").sortWithinPartitions("first")
    candidates = stage(ordered.select(F.monotonically_increasing_id().alias("ord"), "h1", "h2", "words"), "candidate-lines")
    every = stage(_variants(candidates, near_words, near_chars), "line-variants")
    several = every.groupBy("key").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most")
    variants = stage(every.join(several, "key", "left_semi"), "shared-variants")
    # replacements: equal without the unit at one place
    replaced = variants.where("place >= 0").groupBy("key", "place").agg(F.min("ord").alias("of"), F.max("ord").alias("last")).where("of < last").drop("last")
    by_place = variants.join(replaced, ["key", "place"]).where("ord > of").select("ord", "of")
    # additions: equal to another line without a unit; either may be the earlier one
    whole = variants.where("place < 0").select("key", F.col("ord").alias("whole"))
    longer = variants.where("place >= 0").join(whole, "key", "left_semi").groupBy("key").agg(F.min("ord").alias("longer"))
    shorter_later = whole.join(longer, "key").where("whole > longer").select(F.col("whole").alias("ord"), F.col("longer").alias("of"))
    longer_later = variants.where("place >= 0").join(whole, "key").where("ord > whole").select("ord", F.col("whole").alias("of"))
    earliest = by_place.unionByName(shorter_later).unionByName(longer_later).groupBy("ord").agg(F.min("of").alias("of"))
    pairs = earliest.join(candidates.select("ord", "h1", "h2", "words"), "ord").join(candidates.select(F.col("ord").alias("of"), F.col("words").alias("of_words")), "of")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [
                _joiner(a, near_words) == _joiner(b, near_words) and one_edit_apart(units(a, near_words, near_chars), units(b, near_words, near_chars))
                for a, b in zip(batch.column("words").to_pylist(), batch.column("of_words").to_pylist())
            ]
            yield batch.select(["h1", "h2"]).filter(pa.array(same, pa.bool_()))

    return pairs.select("h1", "h2", "words", "of_words").mapInArrow(verify, "h1 long, h2 long")


def repeated_lines(rows: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc_id, row, exact, near): the numbers of the lines to drop of each row of rows (doc_id, row, text) that has any."""
    lines = stage(line_table(rows, near_words, near_chars), "lines")
    distinct = stage(lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.any_value("halves").alias("halves")), "distinct-lines")
    near = _near_lines(rows, distinct, near_words, near_chars).withColumn("near", F.lit(True))
    judged = distinct.select("h1", "h2", "first", "last").join(near, ["h1", "h2"], "left").where(F.col("near") | (F.col("first") != F.col("last")))
    met = lines.select("doc_id", "row", "line", "h1", "h2").join(judged.select("h1", "h2", "first", "near"), ["h1", "h2"]).where(F.col("near") | (_place() != F.col("first")))
    exact = _place() != F.col("first")
    # rows of one place, which equal rows make, are one
    return met.groupBy("doc_id", "row").agg(F.collect_set(F.when(exact, F.col("line"))).alias("exact"), F.collect_set(F.when(~exact, F.col("line"))).alias("near"))


def _rewritten(docs: DataFrame, added: list[str], near_words: int, near_chars: int) -> DataFrame:
    """docs without repeated lines, with three columns of counts named ``added``."""
    of, row, exact_lines, near_lines = free_names([*docs.columns, *added], "of_doc", "of_row", "exact_lines", "near_lines")
    keyed = _keyed(docs, of, row)
    rows = keyed.select(F.col(of).alias("doc_id"), F.col(row).alias("row"), "text")
    drops = repeated_lines(rows, near_words, near_chars).select(F.col("doc_id").alias(of), F.col("row").alias(row), F.col("exact").alias(exact_lines), F.col("near").alias(near_lines))
    schema, names = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)]), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            texts, counts = [], ([], [], [])
            for text, exact, near in zip(*(batch.column(c).to_pylist() for c in ("text", exact_lines, near_lines))):
                lines = (text or "").encode().split(b"\n")
                gone = {*(exact or ()), *(near or ())}
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode() if gone else text)
                counts[0].append(sum(not x.isspace() and x != b"" for x in lines))
                counts[1].append(len(exact or ()))
                counts[2].append(len(near or ()))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c, pa.int64()) for c in counts], names=schema.names)

    return keyed.join(drops, [of, row], "left").drop(of, row).mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs (doc_id, text, ...) without repeated lines, with n_lines, n_exact and n_near.

    ``text`` loses the dropped lines (the others stay as they are), n_lines counts the lines of
    the old text that have a word, and the two others those dropped as equal and as one edit
    apart. A document without repeats keeps its text; one that loses every line has an empty
    text; a null text stays null. Rows of equal doc_id and text are one document: the same lines
    go from each; other rows of one doc_id are documents of their own, by a hash of the text.
    Rows without a doc_id are a document each and come after all others. Texts and lines may be of any length. No documents
    give no rows; other columns stay, but for those with one of the three names.
    """
    added = ["n_lines", "n_exact", "n_near"]
    return _rewritten(docs.select([c for c in docs.columns if c not in added]), added, near_words, near_chars)


def keep_new_text(docs: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with repeated lines dropped; a document that had words and has none left goes. All columns stay, whatever their names; n_chars is that of the new text."""
    added = free_names(docs.columns, "n_lines", "n_exact", "n_near")
    done = _rewritten(docs, added, near_words, near_chars)
    left = (F.col(added[1]) + F.col(added[2]) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return done.where(left).select(*((F.char_length("text").cast("long") if c == "n_chars" else F.col(c)).alias(c) for c in docs.columns))
