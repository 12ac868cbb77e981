"""Source divergence audit: how far the word use of a language's sources lies apart, term by term.

Texts are counted by task: terms are dictionary-encoded, documents and groups are numbers, and occurrences and
documents are counted by (group, id); a task adds up many batches before it sends sums on. One shuffle by (lang, term)
adds those up, and terms in fewer than `least` documents of their language go. The rest is sorted by (lang, term) in
ranges. A range is read as a stream and cut to chunks of at most `CELLS` cells (sources times
terms): the chunk's kept terms are a sorted array, searchsorted turns terms to ids and a bincount over group and id
makes the chunk's counts one dense vector for each source. Shares p, differences and their sums are int64 arithmetic on
these vectors. Ids keep the UTF-8 order, so the first of equal values is the one with the smaller id. A range sends one
sum for each pair of sources and the `most` highest terms of each source. Every task knows the languages' sources: s of
them make s * (s - 1) rows of the result, so that they are few wherever the result can be written.

Defined cases: null texts, languages and sources are ''; a group without terms, or of a language without kept terms,
has pairs with what a count of 0 gives (0 if no term is kept) and no term rows; a language of one source has no pair;
repeated rows are documents of their own; texts and terms of any length count whole; equal values rank by the item's
UTF-8 bytes; an empty table gives no rows; extra columns are ignored. Counts are exact up to 9 * 10^15 occurrences in a
language, as are sums below 2^63.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findling.llm.shared import cut, sized, table, tidy

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_find = re.compile(rb"[a-z\x80-\xff]+").findall  #: of lower-cased UTF-8: letters a to z and all beyond ASCII
LEAST, MOST, WHOLE = 3, 200, 1_000_000_000
HELD, SLICE, CELLS = 1_000_000, 1 << 22, 1 << 20  #: sums a task holds before it sends them on; bytes of text counted at once; cells of a chunk
COUNTS = "lang string, source string, term string, n long, docs long"


def shares(counts: np.ndarray, total: np.ndarray, whole: int = WHOLE) -> np.ndarray:
    """1 + floor(whole * (count + 1) / total) in int64, by long division in steps of a thousand, as the product need not fit. total: of each row, at least count + 1."""
    over, done = counts + 1, np.zeros_like(counts)
    steps, rest = [], whole
    while rest > 1:
        steps.append(min(rest, 1000))
        rest //= steps[-1]
    whole_part, over = np.divmod(over, total[:, None])
    done += whole_part
    for step in steps:
        digit, over = np.divmod(over * step, total[:, None])
        done = done * step + digit
    return done + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, in parts that are still to be added up."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in sliced(batch):
                parts.append(counted(part))
                size += parts[-1].num_rows
                if size >= held:
                    whole = summed(parts)
                    if whole.num_rows >= held // 2:
                        yield from whole.to_batches()
                        whole = whole.slice(0, 0)
                    parts, size = [whole], whole.num_rows
        if parts:
            yield from summed(parts).to_batches()

    return rows.mapInArrow(run, COUNTS)


def sliced(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows with texts of some `most` bytes, or one row."""
    ends, start = np.cumsum(pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def counted(part: pa.RecordBatch) -> pa.Table:
    """COUNTS of some documents: terms are dictionary-encoded and counted by (document, id), then by (group, id)."""
    found = [_find(text.as_py().translate(LOWER)) for text in part.column(2).cast(pa.binary())]
    terms = pa.array(chain.from_iterable(found), pa.binary()).dictionary_encode()
    width = max(1, len(terms.dictionary))
    seen, n = np.unique(np.repeat(np.arange(len(found)) * width, [len(f) for f in found]) + terms.indices.to_numpy(), return_counts=True)
    groups: dict[tuple[str, str], int] = {}
    number = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int64)
    cells, at = np.unique(number[seen // width] * width + seen % width, return_inverse=True)
    names = pa.table({"lang": pa.array([g for g, _ in groups], pa.string()), "source": pa.array([g for _, g in groups], pa.string())}).take(cells // width)
    total = np.zeros(len(cells), np.int64)
    np.add.at(total, at, n)
    return pa.table([*names.columns, terms.dictionary.take(pa.array(cells % width)).cast(pa.string()), pa.array(total), pa.array(np.bincount(at, minlength=len(cells)))], ["lang", "source", "term", "n", "docs"])


def summed(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


class Language:
    """What chunks of a language add up to: sums for pairs of sources, and the highest terms of each source."""

    def __init__(self, sources: list[str], sizes: list[int], kept: int, most: int):
        self.sources, self.most = sources, most  #: sorted
        self.totals = np.array([*sizes, sum(sizes)], np.int64) + kept
        self.pairs = np.zeros((len(sources), len(sources)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]

    def add(self, terms: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> None:
        """A chunk: rows of term, group and count, sorted by term."""
        kept = terms[np.append(True, terms[1:] != terms[:-1])] if len(terms) else terms
        ids, width = np.searchsorted(kept, terms), len(kept)
        cells = np.bincount(groups * width + ids, minlength=len(self.sources) * width)  # is a group's count there: 0 or 1 rows
        dense = np.zeros(len(cells), np.int64)
        dense[groups * width + ids] = counts
        dense = dense.reshape(len(self.sources), width)
        p = shares(np.vstack([dense, dense.sum(0)]), self.totals)
        for b in range(len(self.sources)):
            self.pairs[:, b] += divergence(p[:-1], p[b]).sum(1)
        whole = p[-1]
        for g in range(len(self.sources)):
            above = np.flatnonzero(cells.reshape(dense.shape)[g].astype(bool) & (p[g] > whole))
            value = divergence(p[g][above], whole[above])
            first = np.argsort(-value, kind="stable")[: self.most]  # ids ascend among equal values
            own = [(-v, kept[i]) for v, i in zip(value[first].tolist(), above[first], strict=True)]
            self.best[g] = sorted([*self.best[g], *own])[: self.most]


def compared(kept: DataFrame, groups: DataFrame, most: int = MOST, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value) of each range of kept, which holds (lang, term, counts: array of (source, n)) with a language's groups."""
    ranged = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    about = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("groups"), F.max("kept").alias("kept"))
    about = {r["lang"]: ([g["source"] for g in r["groups"]], [g["size"] for g in r["groups"]], r["kept"]) for r in about.collect()}
    sent = kept.sparkSession.sparkContext.broadcast(about)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of = None, None
        for batch in batches:
            langs = batch.column(0)
            for name in dict.fromkeys(langs.to_pylist()):
                rows = batch.filter(pa.compute.equal(langs, pa.scalar(name, langs.type)))
                if name != of:
                    if now:
                        yield told(of, now)
                    of, now = name, Language(*sent.value[name], most)
                step = max(1, cells // (len(now.sources) + 1))
                numbers = {s.encode(): i for i, s in enumerate(now.sources)}
                for i in range(0, rows.num_rows, step):
                    chunk = rows.slice(i, step)
                    own, lengths = chunk.column(2).flatten(), np.diff(chunk.column(2).offsets.to_numpy())
                    dictionary = own.field(0).dictionary_encode()
                    number = np.array([numbers[s.encode()] for s in dictionary.dictionary.to_pylist()], np.int64)
                    terms = np.array([t.encode() for t in chunk.column(1).to_pylist()], object)
                    now.add(np.repeat(terms, lengths), number[dictionary.indices.to_numpy()], own.field(1).to_numpy())
        if now:
            yield told(of, now)

    def told(of: str, now: Language) -> pa.RecordBatch:
        rows = [(of, a, "pair", b, int(now.pairs[i, j])) for i, a in enumerate(now.sources) for j, b in enumerate(now.sources) if i != j]
        rows += [(of, a, "term", t.decode(), -v) for a, own in zip(now.sources, now.best, strict=True) for v, t in own]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], ["lang", "source", "part", "item", "value"])

    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    return ranged.mapInArrow(run, "lang string, source string, part string, item string, value long")


@tidy
def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, most: int = MOST) -> DataFrame:
    """(lang, source, part, item, value, rank) for the pairs of sources of each language and the telling terms of each source."""
    counted = term_counts(docs, text, lang, source).repartition("lang", "term")  # added up by task already; the aggregates below need no other shuffle
    by_group = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = by_group.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = cut(terms.where(F.col("docs") >= least).select("lang", "term", "counts"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(name(lang).alias("lang"), name(source).alias("source")).distinct()
    sizes = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("size"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = cut(groups.select("lang", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept")))
    found = cut(compared(kept, groups, most))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("kept = 0")
    alone = bare.select("lang", "source").join(sized(bare.select("lang", F.col("source").alias("item"))), "lang").where("source <> item")
    none = alone.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return pairs.union(none).withColumn("rank", F.row_number().over(order)).union(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as materialized (select k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as materialized (select lang, term from t group by all having count(distinct k) >= 3),
v as (select lang, count(*) as v from kept group by all),
g as materialized (select distinct lang, source from d),
c as materialized (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
n as (select lang, source, sum(n)::bigint as total from c group by all),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(n.total, 0) + v.v) as p
  from g join kept k on g.lang = k.lang join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join n on n.lang = g.lang and n.source = g.source),
w as (select c.lang, c.term, 1 + (1000000000::hugeint * (sum(c.n)::bigint + 1)) // (any_value(m.total) + any_value(v.v)) as q
  from c join (select lang, sum(n)::bigint as total from c group by all) m on c.lang = m.lang join v on v.lang = c.lang group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
all_pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, ((p - q) * (p - q) // q)::bigint as value from p join w on p.lang = w.lang and p.term = w.term where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from (from all_pairs union all from terms)
qualify part = 'pair' or rank <= 200
"""
