"""Stories that are nearly the same text.

Method: universe-partition pigeonhole. A text is the set of its runs of eight characters. Sets fall into size
bands (powers of two; sets with a Jaccard similarity of at least one half lie in one band or in neighbouring
ones, so a set is entered for its own band and as a guest for the next; two guests meet in their own band). The
universe of a band is a hash-chosen part of all runs that leaves 32 to 64 of them to a set of the band, cut into
``SEGMENTS`` segments by hash. A set's signatures are the subsets that fall into a segment and all subsets with one
run deleted; one common signature makes two sets candidates. Signatures are allocated by cost, the number of
sets that hold them: those of one set are dropped, and those of more than ``CELL`` sets are cut into cells of at
most two blocks, however many sets hold them, so families of any size are found whole. Within a cell a sketch of 256
bits throws out pairs that are far from similar before any pair is written. Candidates are verified exactly on the
whole sets, cell by cell, so a text travels once for a block of partners and not once for each.

The literal guarantee of the pigeonhole at similarity one half needs a segment for every third run of a set,
hundreds of signatures a text; on the band's universe it holds with a probability, which grows with the
similarity (measured in the README). Sets of fewer than ``TINY`` runs take every run for a segment and, of these, the
cheapest that the bound leaves (more than half), which loses nothing. Equal sets are one class from the start.

Texts without content are no case; a text of fewer than eight characters has no runs and is in no pair.
Null titles count as empty. Texts are read whole.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.boilerplate import marked_pages, story
from lectern.llm.components import components
from lectern.llm.lines import FEW_IDS
from lectern.runtime import load, release, staged

RUN = 8
SIMILARITY = 0.5
SEGMENTS = 10
#: Runs that a signature holds at least; fewer say too little.
HELD = 3
TINY = 32
#: Sets of one block: a cell has at most two of them, which bounds the rows and texts a task holds at once.
CELL = 64
#: 64-bit words of a sketch, the runs it is made of at least, and the similarity of sketches from which a pair is verified.
WORDS = 4
SKETCHED = 64
CLOSE = 0.4
#: Members of a class of equal texts up to which its pairs are listed one by one; larger ones link to their first.
LISTED = 100
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: What a table of letters has for a code point that was not met yet, one of several letters without its accents, and one without any; else its letter.
UNMET, SEVERAL, NONE = 0, 1, 2


def letter_table() -> np.ndarray:
    """The letter or digit that is left of each code point, to be filled as they are met."""
    return np.full(sys.maxunicode + 1, UNMET, dtype=np.uint32)


def _plain(text: str) -> str:
    """The letters and digits of a text without their accents; each code point has its own, as only marks change places."""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKD", text)))


def _letters(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    found = letters.take(codes)
    if found.min(initial=NONE) == UNMET:
        for c in np.unique(codes[found == UNMET]).tolist():
            plain = _plain(chr(c))
            letters[c] = NONE if not plain else ord(plain) if len(plain) == 1 else SEVERAL
        found = letters.take(codes)
    return found


def comparable(text: str, letters: np.ndarray) -> np.ndarray:
    """The code points of a text in lower case, without accents, letters and digits only."""
    text = text.lower()
    found = _letters(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), letters)
    if found.min(initial=NONE) == SEVERAL:
        return np.frombuffer(_plain(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return found.compress(found > NONE)


def mixed(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= B
    y ^= y >> np.uint64(27)
    y *= C
    y ^= y >> np.uint64(31)
    return y


def window_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash for each place in the code points where a run begins."""
    h = codes.astype(np.uint64)
    # Doubling: runs of two, four and eight characters, each a mix of two halves.
    width = 1
    while width < RUN:
        if width == 1:  # code points have no bits beyond the 29th
            right = h[1:] * B
        else:
            right = h[width:] >> np.uint64(29)
            right ^= h[width:]
            right *= B
        h = h[:-width] * A
        h += right
        width *= 2
    return mixed(h)


def distinct_runs(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(runs, sizes): the hashes of the distinct runs of comparable texts, text after text and sorted in each, and how many each has."""
    n = np.array([len(c) for c in codes], dtype=np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    h = window_hashes(np.concatenate([*codes, np.zeros(RUN - 1, dtype=np.uint32)]))
    for start, end in zip(starts.tolist(), (ends - RUN + 1).tolist()):
        if end > start:
            h[start:end].sort()
    kept = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=kept[1:])
    kept[starts[n >= RUN]] = True
    for k in range(1, RUN):  # what begins too near to the end of its text is no run
        kept[(ends - k)[n >= k]] = False
    return h.compress(kept), np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])])


SALTS = np.stack([mixed((np.arange(SEGMENTS, dtype=np.uint64) + np.uint64(band * SEGMENTS)) * A) for band in range(64)])


def band_signatures(runs: np.ndarray, text: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, text of each): the subsets of the segments and their one-deletion neighbours of texts whose runs lie one after the other, ``band`` by text."""
    chosen = (runs & universe_mask(band, TINY)[text]) == 0
    runs, text = runs[chosen], text[chosen]
    place = text * SEGMENTS + (runs >> np.uint64(40)).astype(np.int64) % SEGMENTS
    counts, sums = np.bincount(place, minlength=len(band) * SEGMENTS), np.zeros(len(band) * SEGMENTS, dtype=np.uint64)
    np.add.at(sums, place, runs)
    sums += SALTS[np.repeat(band, SEGMENTS), np.tile(np.arange(SEGMENTS), len(band))]
    held, often = np.nonzero(counts >= HELD)[0], counts[place] > HELD
    return mixed(np.concatenate([sums[held], sums[place[often]] - runs[often]])), np.concatenate([held // SEGMENTS, text[often]])


def universe_mask(band: np.ndarray, least: int) -> np.ndarray:
    """The bits that are zero in the hashes of the part of the universe that leaves ``least`` runs or more to a set of the band."""
    return (np.uint64(1) << np.maximum(0, band - least.bit_length() + 1).astype(np.uint64)) - np.uint64(1)


def sketch_bits(runs: np.ndarray, text: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A bit for each run of a part of the universe: a row of words for each text."""
    chosen = (runs & universe_mask(band, SKETCHED)[text]) == 0
    at = (runs[chosen] >> np.uint64(33)) & np.uint64(64 * WORDS - 1)
    bits = np.zeros(len(band) * WORDS, dtype=np.uint64)
    np.bitwise_or.at(bits, text[chosen] * WORDS + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits.reshape(-1, WORDS)


#: home and guest: signatures in the own and the next band; few: all runs of a small set; bits: the sketches of both bands.
SKETCH = "id long, size int, same long, text string, home array<long>, guest array<long>, few array<long>, bits array<long>"
#: Texts that are sketched at once, and those whose runs are hashed at once (few enough for the processor's caches).
TOGETHER = 500
HASHED = 32


def sketch_batch(keys: list[int], texts: list[str], letters: np.ndarray) -> pa.RecordBatch | None:
    """The rows of ``SKETCH`` of the texts that have runs."""
    told = [comparable(t, letters) for t in texts]
    runs, sizes = map(np.concatenate, zip(*(distinct_runs(told[at : at + HASHED]) for at in range(0, len(told), HASHED))))
    kept = [(k, codes) for k, codes, n in zip(keys, told, sizes.tolist()) if n]
    if not kept:
        return None
    sizes = sizes[sizes > 0]
    text = np.repeat(np.arange(len(kept)), sizes)
    band = np.frexp(sizes.astype(np.float64))[1] - 1
    same = mixed(np.add.reduceat(runs, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))

    def lists(values: np.ndarray, of: np.ndarray) -> pa.ListArray:
        ends = np.cumsum(np.bincount(of, minlength=len(kept)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values[np.argsort(of, kind="stable")].view(np.int64)))

    found = {
        "id": pa.array([k for k, _ in kept], pa.int64()), "size": pa.array(sizes, pa.int32()), "same": pa.array(same.view(np.int64)),
        "text": pa.array([c.tobytes().decode("utf-32-le", "surrogatepass") for _, c in kept], pa.string()),
    }
    for name, more, least in (("home", 0, TINY), ("guest", 1, TINY // 2)):
        own = sizes[text] >= least
        found[name] = lists(*band_signatures(runs[own], text[own], band + more))
    small = sizes[text] < 2 * TINY
    found["few"] = lists(mixed(runs[small] + B), text[small])
    bits = np.concatenate([sketch_bits(runs, text, band), sketch_bits(runs, text, band + 1)], axis=1)
    found["bits"] = lists(bits.reshape(-1), np.repeat(np.arange(len(kept)), 2 * WORDS))
    return pa.RecordBatch.from_pydict(found)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = letter_table()
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            keys, titles, contents, codes = (batch.column(c).slice(at, TOGETHER).to_pylist() for c in ("id", "title", "content", "codes"))
            made = sketch_batch(keys, [f"{t or ''} {story(c, k)}" for t, c, k in zip(titles, contents, codes)], letters)
            if made is not None:
                yield made


def sketches(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """``SKETCH`` of every article with content; equal sets have equal ``same``."""
    told = marked_pages(articles.where(F.trim("content") != ""), sources, ("title",))
    made = staged(told.mapInArrow(_sketched, SKETCH), "sketches")
    release(told)
    return made


def postings(sets: DataFrame) -> DataFrame:
    """(sig, id, own, tiny): the signatures of each set; two guests (``own`` false) of one signature are no candidates through it."""
    marked = lambda c, own: F.transform(c, lambda x: F.struct(x.alias("sig"), F.lit(own).alias("own")))
    wide = sets.select("id", F.explode(F.concat(marked("home", True), marked("guest", False))).alias("s")).select("s.sig", "id", "s.own", F.lit(False).alias("tiny"))
    # Each run of a small set is a segment; two similar sets share one among the cheapest of either, if one more is taken than may differ.
    few = sets.select("id", "size", F.explode("few").alias("sig"))
    cost = few.groupBy("sig").agg(F.count(F.lit(1)).alias("cost"))
    by_cost = few.join(cost, "sig").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("cost", "sig"))).alias("runs"))
    enough = (F.col("size") - F.ceil(F.col("size") * F.lit(SIMILARITY)) + 1).cast("int")
    small = by_cost.select(F.explode(F.slice("runs", F.lit(1), enough)).alias("r"), "id", "size").select("r.sig", "id", (F.col("size") < TINY).alias("own"), F.lit(True).alias("tiny"))
    return wide.unionByName(small)


def _whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by ``cell``, cut only between cells."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        cell = pdf["cell"].to_numpy()
        last = int(np.searchsorted(cell, cell[-1]))
        rest = pdf.iloc[last:].reset_index(drop=True)
        if last:
            yield pdf.iloc[:last]
    if rest is not None:
        yield rest


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, cell): the pairs of each cell whose sizes and sketches allow the similarity."""
    for pdf in _whole_cells(batches):
        cell, key, size, own, tiny, split, block = (pdf[c].to_numpy() for c in ("cell", "id", "size", "own", "tiny", "split", "block"))
        bits = np.stack([pdf[f"w{k}"].to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)
        out, at, d = [], np.arange(len(cell)), 0
        while True:  # every row with the row d places on, as long as any such two are of one cell
            d += 1
            at = at[at + d < len(cell)]
            at = at[cell[at] == cell[at + d]]
            if not len(at):
                break
            i, j = at, at + d
            fits = (own[i] | own[j]) & (key[i] != key[j]) & (np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j])) & (~split[i] | (block[i] != block[j]))
            i, j = i[fits], j[fits]
            both, either = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (bits[i] & bits[j], bits[i] | bits[j]))
            fits = tiny[i] | (both >= CLOSE * either)
            if fits.any():
                out.append((i[fits], j[fits]))
        if out:
            i, j = map(np.concatenate, zip(*out))
            yield pd.DataFrame({"a": np.minimum(key[i], key[j]), "b": np.maximum(key[i], key[j]), "cell": cell[i]})


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b, cell) with a < b: the pairs of sets that share a signature and may be similar, each with one cell where they meet."""
    # One shuffle: the window spills a signature's rows and holds none of them; they part again by id before cells multiply them.
    of_sig = Window.partitionBy("sig")
    post = postings(sets).withColumn("cost", F.count(F.lit(1)).over(of_sig)).withColumn("met", F.max("own").over(of_sig)).where((F.col("cost") > 1) & F.col("met"))
    known = sets.select("id", "size", "bits")
    count = F.ceil(F.col("cost") / F.lit(CELL)).cast("int")
    placed = post.select("sig", "id", "own", "tiny", count.alias("blocks"), F.pmod(F.xxhash64("id"), count).cast("int").alias("block"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.xxhash64("sig", F.least("block", o), F.greatest("block", o)).alias("cell"), (o != F.col("block")).alias("split")))
    words = [F.get("bits", F.when(F.col("own") | F.col("tiny"), F.lit(k)).otherwise(F.lit(k + WORDS))).alias(f"w{k}") for k in range(WORDS)]
    rows = placed.join(known, "id").select("id", "size", "own", "tiny", "block", F.explode(cells).alias("c"), *words)
    rows = rows.select("c.cell", "c.split", "id", "size", "own", "tiny", "block", *(f"w{k}" for k in range(WORDS)))
    found = rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(_close, "a long, b long, cell long")
    return found.groupBy("a", "b").agg(F.min("cell").alias("cell"))


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, similarity) of the asked pairs of each cell that are similar, on the sets of all their runs."""
    for pdf in _whole_cells(batches):
        cell, key, partners, out, at = pdf["cell"].to_numpy(), pdf["id"].tolist(), pdf["partners"].tolist(), [], 0
        while at < len(pdf):  # whole cells, and as many as make HASHED texts
            end = int(np.searchsorted(cell, cell[min(at + HASHED, len(pdf)) - 1], side="right"))
            runs, sizes = distinct_runs([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in pdf["text"].iloc[at:end]])
            sets = dict(zip(zip(cell[at:end].tolist(), key[at:end]), np.split(runs, np.cumsum(sizes)[:-1])))
            for c, a, asked in zip(cell[at:end].tolist(), key[at:end], partners[at:end]):
                for b in map(int, asked):
                    p, q = sets[c, a], sets[c, b]
                    union = np.sort(np.concatenate([p, q]))
                    both = int(np.count_nonzero(union[1:] == union[:-1]))
                    if both >= SIMILARITY * (len(union) - both):
                        out.append((a, b, both / (len(union) - both)))
            at = end
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])


def verified(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, cell) that are similar; a cell's texts travel once each."""
    asked = pairs.select("cell", F.col("a").alias("id"), F.col("b").alias("partner"))
    asked = asked.unionByName(pairs.select("cell", F.col("b").alias("id"), F.lit(None).cast("long").alias("partner")))
    asked = asked.groupBy("cell", "id").agg(F.collect_list("partner").alias("partners"))  # at most the sets of a cell
    texts = sketch.select("id", "text").join(asked.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    return asked.join(texts, "id").repartition("cell").sortWithinPartitions("cell").select("cell", "id", "text", "partners").mapInPandas(_similar, "a long, b long, similarity double")


def links(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): (id, rep) of every text with the first id of its class of equal sets, and (a, b, similarity) between those first ids."""
    firsts = sketch.groupBy("same").agg(F.min("id").alias("rep"))
    classes = staged(sketch.select("id", "same").distinct().join(firsts, "same").select("id", "rep"), "classes")
    # Signatures stay where they are: only the ids of the copies, mostly few, travel to them.
    copies = classes.where(F.col("id") != F.col("rep")).select("id")
    copies = F.broadcast(copies) if copies.count() <= FEW_IDS else copies
    sets = sketch.drop("text", "same").join(copies, "id", "left_anti")
    return classes, verified(staged(candidates(sets), "candidates"), sketch)


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    articles, sources = load(spark, sf_dir, "articles"), load(spark, sf_dir, "sources")
    classes, pairs = links(sketches(articles, sources))
    return classes, staged(pairs, "similar")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b), smaller first: articles that tell nearly the same text.

    Copies of either text take part in its pairs; of a class of more than ``LISTED`` equal texts the first
    stands for the others, which are linked to it.
    """
    classes, pairs = _found(spark, sf_dir)
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    copied = classes.join(sizes, "rep")
    small, large = copied.where(F.col("copies") <= LISTED), copied.where(F.col("copies") > LISTED)
    lists = small.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    ordered = lambda x: F.transform(F.filter("ids", lambda y: y > x), lambda y: F.struct(x.alias("id_a"), y.alias("id_b")))
    equal = lists.select(F.explode(F.flatten(F.transform("ids", ordered))).alias("p")).select("p.*")
    star = large.where(F.col("id") != F.col("rep")).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    members = lambda side: lists.select(F.col("rep").alias(side), F.col("ids").alias(f"{side}s"))
    spread = pairs.join(members("a"), "a", "left").join(members("b"), "b", "left")
    either = lambda side: F.coalesce(F.col(f"{side}s"), F.array(side))
    across = spread.select(F.explode(either("a")).alias("x"), either("b").alias("ys")).select("x", F.explode("ys").alias("y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return equal.unionByName(star).unionByName(across).distinct()


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, class_id, links): every article with a story, the first article of its class, and how many other texts it is linked to."""
    classes, pairs = _found(spark, sf_dir)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    joined = components(pairs.select("a", "b")).select(F.col("v").alias("rep"), "c")
    return classes.join(ends, "rep", "left").join(joined, "rep", "left").select("id", F.coalesce("c", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
