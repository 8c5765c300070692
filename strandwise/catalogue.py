"""Queries over the driver's tables, one an operator, and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import limit_symbols, sequences
from .functions import columns
from .operators import backward
from .operators import bwt as bw
from .operators import integers, intervals, irreducible, lcp, matching, ranges, routed, symbols, validate
from .operators import suffix_array as sa
from .plans.ranking import global_rank
from .plans.storage import materialise

RATE, PREFIX, SHARED = 8, 20_000, 40
#: Substrings that pattern queries look for.
PATTERNS = ("the", "e", "tion", "er th", "What", "zzzz", "a")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark(spark, sf_dir):
    return sequences(_table(spark, sf_dir, "benchmark"), "item_id", "text")


def conversations(spark, sf_dir):
    return sequences(_table(spark, sf_dir, "conversations"), F.col("conv_id") * 100 + F.col("turn"))


def part_names(spark, sf_dir):
    return sequences(_table(spark, sf_dir, "part"), "p_partkey", "p_name")


def nation_names(spark, sf_dir):
    return sequences(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


def documents(spark, sf_dir):
    return sequences(_table(spark, sf_dir, "documents"), "doc_id", "text")


def reference(spark, sf_dir):
    """All benchmark texts as one."""
    rows = benchmark(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("doc", "text"))).alias("all"))
    return rows.select(F.lit(0).cast("long").alias("doc"), F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"))


def _codes(spark, sf_dir):
    """(seq, pos, value): the users of all events in the order of the events, one sequence."""
    rows = _table(spark, sf_dir, "events")
    return rows.select(F.lit(0).cast("long").alias("seq"), F.col("event_id").alias("pos"), F.col("user_id").cast("long").alias("value"))


def _values(spark, sf_dir):
    return lcp.lcp_array(nation_names(spark, sf_dir)).select(F.col("rnk").alias("i"), F.col("lcp").alias("value"))


def _patterns(spark):
    return spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")


def gsa_benchmark(spark, sf_dir):
    return sa.gsa(benchmark(spark, sf_dir))


def gsa_part_names(spark, sf_dir):
    return sa.gsa(part_names(spark, sf_dir))


def gsa_nation_names(spark, sf_dir):
    return sa.gsa(nation_names(spark, sf_dir))


def gsa_conversations(spark, sf_dir):
    return sa.gsa(conversations(spark, sf_dir))


def gsa_documents(spark, sf_dir):
    """All suffixes of all documents, on tables; SQL would have to hold every suffix, so the next query checks this one."""
    return sa.gsa(documents(spark, sf_dir), plan="cover")


def gsa_documents_check(spark, sf_dir):
    """That array, checked in linear time."""
    return validate.check_linear(documents(spark, sf_dir), gsa_documents(spark, sf_dir))


def gsa_cover(spark, sf_dir):
    """The plan for collections of any size."""
    return sa.gsa(conversations(spark, sf_dir), plan="cover")


def gsa_cover_copies(spark, sf_dir):
    """The same over texts of which many are equal."""
    return sa.gsa(part_names(spark, sf_dir), plan="cover")


def gsa_doubling(spark, sf_dir):
    """The plan that ranks by ever wider prefixes."""
    return sa.gsa(benchmark(spark, sf_dir), plan="doubling")


def gsa_with_terminators(spark, sf_dir):
    return sa.gsa(benchmark(spark, sf_dir), include_terminator=True)


def gsa_prefix_limit(spark, sf_dir):
    return sa.gsa(limit_symbols(conversations(spark, sf_dir), PREFIX))


def isa_benchmark(spark, sf_dir):
    return sa.isa(sa.gsa(benchmark(spark, sf_dir)))


def single_text_sa(spark, sf_dir):
    return sa.per_document(benchmark(spark, sf_dir))


def int_sa(spark, sf_dir):
    return sa.integer_suffix_array(_codes(spark, sf_dir))


def unique_suffix_count(spark, sf_dir):
    return sa.unique_suffixes(part_names(spark, sf_dir))


def suffix_text(spark, sf_dir):
    b = benchmark(spark, sf_dir)
    return symbols.suffix_at(b, symbols.suffixes(b, include_terminator=True))


def gather_ranks(spark, sf_dir):
    b = benchmark(spark, sf_dir)
    return sa.gather(sa.isa(sa.gsa(b)), symbols.lms_suffixes(b), ["doc", "idx"]).select("doc", "idx", "rnk")


def symbol_rows(spark, sf_dir):
    return symbols.symbols(benchmark(spark, sf_dir))


def phi_array(spark, sf_dir):
    return lcp.phi(benchmark(spark, sf_dir))


def lcp_array(spark, sf_dir):
    return lcp.lcp_array(part_names(spark, sf_dir))


def lcp_doubling(spark, sf_dir):
    return sa.gsa_lcp(nation_names(spark, sf_dir), plan="doubling").select("rnk", "lcp")


def lcp_cover(spark, sf_dir):
    """On tables, from irreducible places."""
    return sa.gsa_lcp(conversations(spark, sf_dir), plan="cover").select("rnk", "lcp")


def irreducible_prefixes(spark, sf_dir):
    docs = benchmark(spark, sf_dir)
    return irreducible.irreducible_prefixes(docs, sa.gsa(docs))


def interval_tree(spark, sf_dir):
    return intervals.tree(lcp.lcp_array(part_names(spark, sf_dir)))


def interval_suffix_links(spark, sf_dir):
    docs = part_names(spark, sf_dir)
    return intervals.suffix_links(sa.gsa(docs), lcp.lcp_array(docs))


def maximal_repeats(spark, sf_dir):
    docs = part_names(spark, sf_dir)
    array = materialise(sa.gsa_lcp(docs, plan="cover"), "part-names")
    return intervals.maximal_repeats(docs, array, array)


def plcp_array(spark, sf_dir):
    return lcp.plcp_array(benchmark(spark, sf_dir))


def unique_prefix_len(spark, sf_dir):
    return lcp.unique_prefix(benchmark(spark, sf_dir))


def longest_repeat(spark, sf_dir):
    return lcp.longest_repeat(benchmark(spark, sf_dir))


def bwt_rows(spark, sf_dir):
    return bw.bwt_rows(benchmark(spark, sf_dir))


def bwt_transform(spark, sf_dir):
    return bw.bwt(benchmark(spark, sf_dir))


def bwt_aux_r8(spark, sf_dir):
    return bw.samples(benchmark(spark, sf_dir), RATE)


def lf_mapping(spark, sf_dir):
    return bw.lf_mapping(bw.bwt(benchmark(spark, sf_dir)))


def unbwt_roundtrip(spark, sf_dir):
    return bw.inverse(bw.bwt(benchmark(spark, sf_dir)))


def unbwt_aux_roundtrip(spark, sf_dir):
    b = benchmark(spark, sf_dir)
    return bw.join_blocks(bw.inverse_blocks(bw.bwt(b), bw.samples(b, RATE), RATE))


def symbol_histogram(spark, sf_dir):
    return symbols.histogram(documents(spark, sf_dir))


def bigram_histogram(spark, sf_dir):
    return symbols.bigrams(conversations(spark, sf_dir))


def bucket_bounds(spark, sf_dir):
    return symbols.bucket_bounds(conversations(spark, sf_dir))


def max_symbol_runs(spark, sf_dir):
    return symbols.max_runs(conversations(spark, sf_dir))


def suffix_types(spark, sf_dir):
    return symbols.suffix_types(benchmark(spark, sf_dir))


def lms_suffixes(spark, sf_dir):
    return symbols.lms_suffixes(conversations(spark, sf_dir))


def lms_per_symbol(spark, sf_dir):
    return symbols.lms_per_symbol(conversations(spark, sf_dir))


def lms_names(spark, sf_dir):
    return symbols.lms_names(part_names(spark, sf_dir))


def collection_lengths(spark, sf_dir):
    return symbols.lengths(documents(spark, sf_dir))


def reference_augmentation(spark, sf_dir):
    return symbols.augmentation(reference(spark, sf_dir), conversations(spark, sf_dir))


def position_buckets(spark, sf_dir):
    rows = symbols.suffixes(benchmark(spark, sf_dir))
    return rows.groupBy("doc", symbols.shift_key(F.col("idx"), 6).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def matching_statistics(spark, sf_dir):
    return matching.matching_statistics(benchmark(spark, sf_dir), part_names(spark, sf_dir))


def matching_statistics_union(spark, sf_dir):
    """The same with short heads and small ranges, so that suffixes cross ranges and double their intervals as those of a very large reference do."""
    return routed.matching_statistics(routed.build(benchmark(spark, sf_dir), width=3, size=256), part_names(spark, sf_dir))


def matching_statistics_documents(spark, sf_dir):
    """Every place of every document against all benchmark texts; only the parse is kept."""
    return matching.parse_stats(matching.matching_statistics(benchmark(spark, sf_dir), documents(spark, sf_dir), augment=True, heads_only=True))


def _inverse(spark, sf_dir):
    return sa.isa(sa.gsa(reference(spark, sf_dir)))


def ms_heads(spark, sf_dir):
    return matching.matching_statistics(benchmark(spark, sf_dir), part_names(spark, sf_dir), heads_only=True)


def parse_stats(spark, sf_dir):
    return matching.parse_stats(ms_heads(spark, sf_dir))


def heads_per_position(spark, sf_dir):
    return matching.heads_per_position(ms_heads(spark, sf_dir))


def head_rank(spark, sf_dir):
    return matching.rank_heads(ms_heads(spark, sf_dir), _inverse(spark, sf_dir))


def head_sort(spark, sf_dir):
    return matching.sort_heads(ms_heads(spark, sf_dir), _inverse(spark, sf_dir))


def head_suffix_array(spark, sf_dir):
    return matching.head_suffix_array(ms_heads(spark, sf_dir), _inverse(spark, sf_dir)).select("rnk", "doc", "k")


def next_head_asof(spark, sf_dir):
    return matching.next_heads(ms_heads(spark, sf_dir))


def match_order_key(spark, sf_dir):
    return matching.full_order_keys(matching_statistics(spark, sf_dir), _inverse(spark, sf_dir))


def match_order(spark, sf_dir):
    return matching.order_by_matches(matching_statistics(spark, sf_dir), _inverse(spark, sf_dir))


def heads_order_check(spark, sf_dir):
    order = matching.head_suffix_array(ms_heads(spark, sf_dir), _inverse(spark, sf_dir))
    return validate.check_heads_order(part_names(spark, sf_dir), order.select("rnk", "doc", "idx"))


def _intervals(spark, sf_dir):
    """(q, first, last, depth): every rank of the nations' suffixes with the next two, and what these three share, less a symbol."""
    array = sa.gsa_lcp(nation_names(spark, sf_dir)).select("rnk", "lcp")
    last = array.agg(F.max("rnk").alias("n")).first()["n"]
    ends = array.select((F.col("rnk") - 1).alias("a"), F.col("lcp").alias("l1")).join(array.select((F.col("rnk") - 2).alias("a"), F.col("lcp").alias("l2")), "a").filter((F.col("a") >= 0) & (F.col("a") + 2 <= last))
    return ends.select(F.col("a").alias("q"), F.col("a").alias("first"), (F.col("a") + 2).alias("last"), F.least("l1", "l2").alias("depth"))


def interval_widen(spark, sf_dir):
    return ranges.widen(_intervals(spark, sf_dir), lcp.lcp_array(nation_names(spark, sf_dir)), part=64)


def interval_contract(spark, sf_dir):
    shorter = _intervals(spark, sf_dir).withColumn("depth", F.greatest(F.col("depth") - 1, F.lit(0)))
    return ranges.contract_left(shorter, sa.gsa(nation_names(spark, sf_dir)), lcp.lcp_array(nation_names(spark, sf_dir)), part=64)


def pattern_count(spark, sf_dir):
    return matching.count_patterns(conversations(spark, sf_dir), _patterns(spark))


def pattern_locate(spark, sf_dir):
    return matching.locate(benchmark(spark, sf_dir), _patterns(spark))


def _benchmark_words(spark, sf_dir):
    """The distinct words of all benchmark texts."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("pattern"))
    return words.filter("pattern <> ''").distinct()


def backward_count(spark, sf_dir):
    """Occurrences of every word of the benchmark within the conversations, all words stepping through their index together."""
    return backward.count(backward.build(conversations(spark, sf_dir)), _benchmark_words(spark, sf_dir))


def backward_locate(spark, sf_dir):
    return backward.locate(backward.build(benchmark(spark, sf_dir)), _benchmark_words(spark, sf_dir))


def interval_refine(spark, sf_dir):
    return matching.refine(benchmark(spark, sf_dir), "th")


def contamination(spark, sf_dir):
    """Longest exact matches of benchmark items in documents."""
    return matching.longest_shared(documents(spark, sf_dir), benchmark(spark, sf_dir), SHARED)


def exact_duplicate_docs(spark, sf_dir):
    return lcp.exact_duplicates(documents(spark, sf_dir))


def psv_nsv(spark, sf_dir):
    return ranges.nearest_smaller(_values(spark, sf_dir), part=64)


def rmq_blocks(spark, sf_dir):
    return ranges.block_minima(_values(spark, sf_dir), 16)


def range_minimum(spark, sf_dir):
    asked = _values(spark, sf_dir).select(F.col("i").alias("q"), F.col("i").alias("first"))
    last = F.least(F.col("first") + (F.col("first") % 50), F.lit(_values(spark, sf_dir).count() - 1).cast("long"))
    return ranges.range_minimum(_values(spark, sf_dir), asked.withColumn("last", last), 16)


def int_lcp(spark, sf_dir):
    return integers.lcp(_codes(spark, sf_dir))


def int_unbwt_roundtrip(spark, sf_dir):
    return integers.inverse_bwt(integers.bwt(_codes(spark, sf_dir)))


def int_bwt_primary(spark, sf_dir):
    return integers.bwt(_codes(spark, sf_dir)).select("seq", "primary").distinct()


def int_histogram(spark, sf_dir):
    return integers.histogram(_codes(spark, sf_dir))


def printable_texts(spark, sf_dir):
    return conversations(spark, sf_dir).select("doc", columns.printable(F.col("text")).alias("text"), columns.log2_floor(F.length("text").cast("long")).alias("bits"))


def neighbour_prefixes(spark, sf_dir):
    """Common prefixes of documents with their successors by number, by comparison of columns."""
    p = part_names(spark, sf_dir)
    other = p.select((F.col("doc") - 1).alias("doc"), F.col("text").alias("other"))
    return p.join(other, "doc").select("doc", columns.common_prefix(F.col("text"), F.col("other")).alias("len"))


def marker_counts(spark, sf_dir):
    negative, zero = columns.marked(F.col("value"))
    return lcp.phi(nation_names(spark, sf_dir)).select((F.col("prev_idx") - F.col("idx")).alias("value")).agg(negative.alias("negative"), zero.alias("zero"))


def gsa_order_check(spark, sf_dir):
    c = conversations(spark, sf_dir)
    return validate.check_order(c, sa.gsa(c))


def heads_check(spark, sf_dir):
    return validate.check_heads(matching_statistics(spark, sf_dir), part_names(spark, sf_dir), reference(spark, sf_dir))


def _new_folder(spark, name):
    import uuid

    from .plans.storage import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _without_marks(docs):
    """Documents numbered from 1 without what FASTA reads as its own."""
    return docs.select((F.col("doc") + 1).alias("doc"), F.translate("text", "\r\n>", "").alias("text"))


def fasta_roundtrip(spark, sf_dir):
    """Benchmark texts without line ends, written as FASTA and read back."""
    from .sources import readers, writers

    path = _new_folder(spark, "fasta")
    writers.write_fasta(_without_marks(benchmark(spark, sf_dir)), path)
    return readers.fasta(spark, path).select("doc", "text")


def _uneven_files(docs, path):
    """FASTA files of very different sizes, whose names are in document order: the first few documents, then ever more a file."""
    from .sources import writers

    number = F.floor(F.log2(F.col("doc"))).cast("int")
    last = docs.agg(F.max("doc")).first()[0]
    for k in range(last.bit_length()):
        writers.write_fasta(docs.filter(number == k).coalesce(1), f"{path}/{k:03d}")
    return f"{path}/*"


def fasta_folder_roundtrip(spark, sf_dir):
    """Benchmark texts in several FASTA files of unequal sizes, read in the order of the files."""
    from .sources import readers

    docs = _without_marks(benchmark(spark, sf_dir))
    return readers.fasta(spark, _uneven_files(docs, _new_folder(spark, "fasta-files"))).select("doc", F.col("header").cast("long").alias("header"), "text")


def fasta_reference_roundtrip(spark, sf_dir):
    """All records of several FASTA files as one reference text."""
    from .sources import readers

    docs = _without_marks(benchmark(spark, sf_dir))
    return readers.fasta_reference(spark, _uneven_files(docs, _new_folder(spark, "fasta-reference")))


def _one_text(docs, separator, end, path):
    """All texts in document order with a separator between them, and an end, as one text file."""
    rows = docs.agg(F.array_sort(F.collect_list(F.struct("doc", "text"))).alias("all"))
    rows.select(F.concat(F.array_join(F.transform("all", lambda x: x["text"]), separator), F.lit(end)).alias("value")).coalesce(1).write.option("lineSep", "\n").text(path)


def raw_reference_roundtrip(spark, sf_dir):
    """Benchmark texts as one raw file with a mark and line ends behind it, which are trimmed."""
    from .sources import readers

    path = _new_folder(spark, "raw")
    _one_text(_without_marks(benchmark(spark, sf_dir)), "", "$\r\n", path)
    return readers.raw_reference(spark, path)


def raw_collection_roundtrip(spark, sf_dir):
    """Conversations as one raw file parted by the separator byte, read back as documents in order."""
    from .sources import readers

    path = _new_folder(spark, "raw-collection")
    _one_text(conversations(spark, sf_dir), readers.SEPARATOR, readers.SEPARATOR, path)
    return readers.raw_collection(spark, path).filter("text <> '\n'")


def gsa_records_roundtrip(spark, sf_dir):
    """The array of nation names through a file of 8-byte records."""
    from .sources import writers

    path = _new_folder(spark, "gsa") + ".gsa"
    writers.write_gsa_records(gsa_nation_names(spark, sf_dir), path)
    return writers.read_gsa_records(spark, path)


def fasta_format_roundtrip(spark, sf_dir):
    """Benchmark texts through the format fasta, written by several tasks and read by byte ranges."""
    from .sources import formats

    path, docs = _new_folder(spark, "fasta-format"), _without_marks(benchmark(spark, sf_dir))
    formats.register(spark)
    rows = docs.repartitionByRange(8, "doc").sortWithinPartitions("doc").select(F.col("doc").cast("string").alias("header"), "text")
    rows.write.format("fasta").mode("append").save(path)
    return formats.read_fasta(spark, path, 4096).select("doc", F.col("header").cast("long").alias("header"), "text")


def gsa_format_roundtrip(spark, sf_dir):
    """The array of part names through the format gsa."""
    from .sources import formats

    path = _new_folder(spark, "gsa-format")
    formats.register(spark)
    formats.ordered(gsa_part_names(spark, sf_dir)).write.format("gsa").mode("append").save(path)
    return spark.read.format("gsa").load(path)


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    gsa_benchmark, gsa_part_names, gsa_nation_names, gsa_conversations, gsa_documents, gsa_documents_check, gsa_cover, gsa_cover_copies, gsa_doubling, gsa_with_terminators, gsa_prefix_limit,
    isa_benchmark, single_text_sa, int_sa, unique_suffix_count, suffix_text, gather_ranks, symbol_rows, phi_array, lcp_array, lcp_doubling, lcp_cover, irreducible_prefixes, plcp_array, interval_tree, interval_suffix_links, maximal_repeats, unique_prefix_len, longest_repeat,
    bwt_rows, bwt_transform, bwt_aux_r8, lf_mapping, unbwt_roundtrip, unbwt_aux_roundtrip,
    symbol_histogram, bigram_histogram, bucket_bounds, max_symbol_runs, suffix_types, lms_suffixes, lms_per_symbol, lms_names, collection_lengths, reference_augmentation, position_buckets,
    matching_statistics, matching_statistics_union, matching_statistics_documents, ms_heads, parse_stats, heads_per_position, head_rank, head_sort, head_suffix_array, next_head_asof, match_order_key, match_order, heads_order_check, interval_widen, interval_contract,
    pattern_count, pattern_locate, backward_count, backward_locate, interval_refine, contamination, exact_duplicate_docs, psv_nsv, rmq_blocks, range_minimum,
    int_lcp, int_unbwt_roundtrip, int_bwt_primary, int_histogram, printable_texts, neighbour_prefixes, marker_counts, gsa_order_check, heads_check, fasta_roundtrip, fasta_folder_roundtrip, fasta_reference_roundtrip, raw_reference_roundtrip, raw_collection_roundtrip, gsa_records_roundtrip, fasta_format_roundtrip, gsa_format_roundtrip,
)


# ---- SQL

_B = "SELECT item_id AS doc, text FROM benchmark"
_C = "SELECT conv_id * 100 + turn AS doc, text FROM conversations"
_P = "SELECT p_partkey AS doc, p_name AS text FROM part"
_N = "SELECT CAST(n_nationkey AS BIGINT) AS doc, n_name AS text FROM nation"
_D = "SELECT doc_id AS doc, coalesce(text, '') AS text FROM documents"


def _suf(docs: str, extra: int = 0) -> str:
    return f"SELECT doc, i AS idx, substr(text, CAST(i + 1 AS INT)) AS suf FROM ({docs}), unnest(range(length(text) + {extra})) u(i)"


def _gsa(docs: str, extra: int = 0) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY suf, doc) - 1 AS BIGINT) AS rnk, idx, doc FROM ({_suf(docs, extra)})"


def _lcp(docs: str) -> str:
    common = "(SELECT coalesce(max(k), 0) FROM range(1, 1 + least(length(a), length(b))) r(k) WHERE left(a, CAST(k AS INT)) = left(b, CAST(k AS INT)))"
    neighbours = f"SELECT CAST(row_number() OVER w - 1 AS BIGINT) AS rnk, doc, idx, suf AS a, coalesce(lag(suf) OVER w, '') AS b FROM ({_suf(docs)}) WINDOW w AS (ORDER BY suf, doc)"
    return f"SELECT rnk, doc, idx, CAST({common} AS BIGINT) AS lcp FROM ({neighbours})"


def _lcp_listed(docs: str) -> str:
    """The same with lists instead of a subquery a row: quicker on many suffixes."""
    common = "len(list_filter(range(1, 1 + least(length(a), length(b))), lambda k: left(a, CAST(k AS INT)) = left(b, CAST(k AS INT))))"
    neighbours = f"SELECT CAST(row_number() OVER w - 1 AS BIGINT) AS rnk, suf AS a, coalesce(lag(suf) OVER w, '') AS b FROM ({_suf(docs)}) WINDOW w AS (ORDER BY suf, doc)"
    return f"SELECT rnk, CAST({common} AS BIGINT) AS lcp FROM ({neighbours})"


def _repeats(docs: str) -> str:
    """All substrings that occur twice or more, with their ranks and the numbers of symbols before and behind them; ends of documents are like no symbol."""
    before = "CASE WHEN idx = 0 THEN 'begin ' || doc ELSE substr(text, CAST(idx AS INT), 1) END"
    behind = "CASE WHEN idx + k = length(text) THEN 'end ' || doc ELSE substr(text, CAST(idx + k + 1 AS INT), 1) END"
    places = f"SELECT rnk, doc, idx, text, unnest(range(1, 1 + length(text) - idx)) AS k FROM ({_gsa(docs)}) JOIN ({docs}) USING (doc)"
    cut = f"SELECT rnk, substr(text, CAST(idx + 1 AS INT), CAST(k AS INT)) AS w, {before} AS before, {behind} AS behind FROM ({places})"
    return f"SELECT w, min(rnk) AS first, max(rnk) AS last, CAST(length(w) AS BIGINT) AS depth, count(DISTINCT before) AS before, count(DISTINCT behind) AS behind FROM ({cut}) GROUP BY w HAVING count(*) > 1"


def _chars(docs: str) -> str:
    return f"SELECT doc, i AS idx, substr(text, CAST(i + 1 AS INT), 1) AS ch FROM ({docs}), unnest(range(length(text))) u(i)"


def _runs(docs: str) -> str:
    islands = f"SELECT doc, idx, ch, idx - row_number() OVER (PARTITION BY doc, ch ORDER BY idx) AS g FROM ({_chars(docs)})"
    return f"SELECT doc, ch, min(idx) AS start, count(*) AS n FROM ({islands}) GROUP BY doc, ch, g"


def _types(docs: str) -> str:
    pairs = f"SELECT doc, idx, ch, lead(ch) OVER (PARTITION BY doc ORDER BY idx) AS nx, lag(ch) OVER (PARTITION BY doc ORDER BY idx) AS pv FROM ({_chars(docs)})"
    nd = "first_value(CASE WHEN ch <> nx THEN nx END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    typed = f"SELECT doc, idx, ch, pv, CASE WHEN coalesce({nd}, '') > ch THEN 'S' ELSE 'L' END AS type FROM ({pairs})"
    return f"SELECT doc, idx, ch, type, (type = 'S' AND pv IS NOT NULL AND pv > ch) AS is_lms FROM ({typed})"


def _bwt_rows(docs: str) -> str:
    return f"SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY suf) - 1 AS BIGINT) AS rnk, idx, CASE WHEN idx = 0 THEN NULL ELSE substr(text, CAST(idx AS INT), 1) END AS symbol, text FROM ({_suf(docs)}) JOIN ({docs}) USING (doc)"


def _transform(docs: str) -> str:
    return f"SELECT doc, any_value(right(text, 1)) || string_agg(symbol, '' ORDER BY rnk) FILTER (symbol IS NOT NULL) AS transform, max(CASE WHEN idx = 0 THEN rnk + 1 END) AS primary FROM ({_bwt_rows(docs)}) GROUP BY doc"


_COMMON = "(SELECT coalesce(max(k), 0) FROM range(1, 1 + least(length(suf), length({r}))) t(k) WHERE left(suf, CAST(k AS INT)) = left({r}, CAST(k AS INT)))"
_REF = "SELECT 0 AS doc, string_agg(text, '' ORDER BY item_id) AS text FROM benchmark"
_ISA = f"SELECT idx AS pos, rnk AS isa FROM ({_gsa(_REF)})"
_MS = f"""
WITH u AS (SELECT -1 AS doc, idx, suf FROM ({_suf(_REF)}) UNION ALL SELECT doc, idx, suf FROM ({_suf(_P)})),
n AS (SELECT *, last_value(CASE WHEN doc = -1 THEN {{'suf': suf, 'idx': idx}} END IGNORE NULLS) OVER (ORDER BY suf, doc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
             first_value(CASE WHEN doc = -1 THEN {{'suf': suf, 'idx': idx}} END IGNORE NULLS) OVER (ORDER BY suf, doc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM u),
l AS (SELECT doc, idx, suf, pv, nx, CASE WHEN pv IS NULL THEN -1 ELSE {_COMMON.format(r="pv.suf")} END AS lp, CASE WHEN nx IS NULL THEN -1 ELSE {_COMMON.format(r="nx.suf")} END AS ln FROM n WHERE doc >= 0)
SELECT doc, idx, CASE WHEN ln >= lp THEN nx.idx ELSE pv.idx END AS pos, CAST(greatest(ln, lp) AS BIGINT) AS len, ln >= lp AS smaller, nullif(substr(suf, CAST(greatest(ln, lp) + 1 AS INT), 1), '') AS next FROM l
"""
_HEADS = f"SELECT doc, idx, pos, len, smaller, next FROM (SELECT *, lag(pos) OVER (PARTITION BY doc ORDER BY idx) AS before FROM ({_MS})) WHERE before IS NULL OR pos <> before + 1"
_KEYS = f"SELECT doc, idx, len, isa, CASE WHEN smaller THEN 0 ELSE 1 END AS side, CASE WHEN smaller THEN len ELSE -len END AS closeness, next FROM ({{rows}}) JOIN ({_ISA}) USING (pos)"
_HEAD_RANK = f"SELECT doc, idx, CAST(dense_rank() OVER (ORDER BY isa, side, closeness, next NULLS FIRST) - 1 AS BIGINT) AS rank FROM ({_KEYS.format(rows=_HEADS)})"
_HEAD_LISTS = f"SELECT doc, list(rank ORDER BY idx) AS a, list(idx ORDER BY idx) AS places FROM ({_HEAD_RANK}) GROUP BY doc"
_HEAD_SA = f"SELECT CAST(row_number() OVER (ORDER BY list_slice(a, k + 1, len(a)), doc) - 1 AS BIGINT) AS rnk, doc, k, places[k + 1] AS idx FROM ({_HEAD_LISTS}), unnest(range(len(a))) u(k)"
_FASTA = "SELECT item_id + 1 AS doc, translate(text, chr(13) || chr(10) || '>', '') AS text FROM benchmark"
_GSA_LCP_N = f"SELECT rnk, doc, idx, lcp FROM ({_lcp(_N)})"
_INTERVALS = f"SELECT a.rnk AS q, a.rnk AS first, a.rnk + 2 AS last, least(b.lcp, c.lcp) AS depth FROM g a JOIN g b ON b.rnk = a.rnk + 1 JOIN g c ON c.rnk = a.rnk + 2"
_WIDENED = "SELECT q, coalesce((SELECT max(g.rnk) FROM g WHERE g.rnk <= i.first AND g.lcp < i.depth), 0) AS first, coalesce((SELECT min(g.rnk) FROM g WHERE g.rnk > i.last AND g.lcp < i.depth), (SELECT count(*) FROM g)) - 1 AS last FROM i"
_PATTERN_SQL = ", ".join(f"('{p}')" for p in PATTERNS)
_EVENTS = "SELECT CAST(0 AS BIGINT) AS seq, list(CAST(user_id AS BIGINT) ORDER BY event_id) AS a FROM events"
_INT_SUF = f"SELECT seq, i AS pos, list_slice(a, i + 1, len(a)) AS s FROM ({_EVENTS}), unnest(range(len(a))) u(i)"
_LOCATE = "SELECT pattern, doc, i AS idx FROM (VALUES {patterns}) p(pattern), ({docs}), unnest(range(length(text))) u(i) WHERE substr(text, CAST(i + 1 AS INT), length(pattern)) = pattern"
_WORDS = "(SELECT DISTINCT unnest(string_split(text, ' ')) AS pattern FROM benchmark)"
_FOUND = "SELECT p.pattern, doc, i AS idx FROM (SELECT doc, i, substr(text, CAST(i + 1 AS INT), n) AS cut FROM (SELECT DISTINCT CAST(length(pattern) AS INT) AS n FROM {words}) l, ({docs}) d, unnest(range(length(text) - n + 1)) u(i)) JOIN (SELECT * FROM {words} WHERE pattern <> '') p ON p.pattern = cut"
_NODES = f"WITH n AS (SELECT * FROM ({_repeats(_P)}) WHERE behind > 1), r AS (SELECT CAST(sum(length(text)) - 1 AS BIGINT) AS z FROM ({_P}))"
_UP = "SELECT c.w, max_by(p, p.depth) AS up FROM (SELECT w, unnest(range(1, depth)) AS k FROM n) c JOIN n p ON p.w = left(c.w, CAST(c.k AS INT)) GROUP BY c.w"
_LCP_N = f"SELECT rnk AS i, lcp AS value FROM ({_lcp(_N)})"

ORACLES: dict[str, str] = {
    "gsa_benchmark": _gsa(_B), "gsa_part_names": _gsa(_P), "gsa_nation_names": _gsa(_N), "gsa_conversations": _gsa(_C), "gsa_doubling": _gsa(_B), "gsa_cover": _gsa(_C), "gsa_cover_copies": _gsa(_P),
    "gsa_documents_check": f"SELECT CAST(sum(length(text)) AS BIGINT) AS n, CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS missing FROM ({_D})", "gsa_with_terminators": _gsa(_B, 1),
    "gsa_prefix_limit": _gsa(f"SELECT doc, left(text, CAST(least(length(text), {PREFIX} - before) AS INT)) AS text FROM (SELECT doc, text, coalesce(sum(length(text)) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_C})) WHERE before < {PREFIX}"),
    "isa_benchmark": _gsa(_B),
    "single_text_sa": f"SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY suf) - 1 AS BIGINT) AS rnk, idx AS pos FROM ({_suf(_B)})",
    "int_sa": f"SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY s) - 1 AS BIGINT) AS rnk, i AS pos FROM (SELECT seq, i, list_slice(a, i + 1, len(a)) AS s FROM ({_EVENTS}), unnest(range(len(a))) u(i))",
    "unique_suffix_count": f"SELECT count(*) AS n_unique FROM (SELECT suf FROM ({_suf(_P)}) GROUP BY suf HAVING count(*) = 1)",
    "suffix_text": f"SELECT doc, idx, suf AS suffix FROM ({_suf(_B, 1)})",
    "gather_ranks": f"SELECT doc, idx, rnk FROM ({_gsa(_B)}) JOIN (SELECT doc, idx FROM ({_types(_B)}) WHERE is_lms) USING (doc, idx)",
    "symbol_rows": f"SELECT doc, idx, ch AS symbol FROM ({_chars(_B)})",
    "phi_array": f"SELECT doc, idx, lag(doc) OVER (ORDER BY rnk) AS prev_doc, lag(idx) OVER (ORDER BY rnk) AS prev_idx FROM ({_gsa(_B)})",
    "lcp_array": f"SELECT rnk, lcp FROM ({_lcp(_P)})", "lcp_doubling": f"SELECT rnk, lcp FROM ({_lcp(_N)})", "plcp_array": f"SELECT doc, idx, lcp AS plcp FROM ({_lcp(_B)})",
    "lcp_cover": _lcp_listed(_C),
    "irreducible_prefixes": f"""SELECT doc, idx, lcp AS plcp FROM (SELECT *, lag(before) OVER (ORDER BY rnk) AS last FROM (SELECT l.*, CASE WHEN idx > 0 THEN substr(text, CAST(idx AS INT), 1) END AS before FROM ({_lcp(_B)}) l JOIN ({_B}) USING (doc)))
        WHERE before IS NULL OR last IS NULL OR before <> last""",
    "interval_tree": f"""{_NODES} SELECT first, last, depth, coalesce(up.first, 0) AS parent_first, coalesce(up.last, z) AS parent_last, coalesce(up.depth, 0) AS parent_depth FROM n LEFT JOIN ({_UP}) u USING (w), r
        UNION ALL SELECT 0, z, 0, NULL, NULL, NULL FROM r""",
    "interval_suffix_links": f"{_NODES} SELECT n.first, n.last, n.depth, coalesce(l.first, 0) AS link_first, coalesce(l.last, z) AS link_last FROM n LEFT JOIN n l ON l.w = substr(n.w, 2), r",
    "maximal_repeats": f"SELECT first, last, depth AS len, g.doc, g.idx FROM ({_repeats(_P)}) JOIN ({_gsa(_P)}) g ON g.rnk = first WHERE before > 1 AND behind > 1",
    "unique_prefix_len": f"SELECT doc, idx, greatest(lcp, coalesce(lead(lcp) OVER (ORDER BY rnk), 0)) AS len FROM ({_lcp(_B)})",
    "longest_repeat": f"SELECT lcp AS len, substr(text, CAST(idx + 1 AS INT), CAST(lcp AS INT)) AS substring FROM ({_lcp(_B)}) JOIN ({_B}) USING (doc) WHERE lcp > 0 ORDER BY lcp DESC, rnk LIMIT 1",
    "bwt_rows": f"SELECT doc, rnk, symbol FROM ({_bwt_rows(_B)})", "bwt_transform": _transform(_B),
    "bwt_aux_r8": f"SELECT doc, idx // {RATE} AS t, rnk + 1 AS isa FROM ({_bwt_rows(_B)}) WHERE idx % {RATE} = 0",
    "lf_mapping": f"SELECT doc, idx AS row, CAST(row_number() OVER (PARTITION BY doc ORDER BY ch, idx) - 1 AS BIGINT) AS lf FROM ({_chars(f'SELECT doc, transform AS text FROM ({_transform(_B)})')})",
    "unbwt_roundtrip": _B, "unbwt_aux_roundtrip": _B,
    "symbol_histogram": f"SELECT ch AS symbol, count(*) AS n FROM ({_chars(_D)}) GROUP BY ch",
    "bigram_histogram": f"SELECT ch AS symbol, nx AS next, count(*) AS n FROM (SELECT ch, lead(ch) OVER (PARTITION BY doc ORDER BY idx) AS nx FROM ({_chars(_C)})) WHERE nx IS NOT NULL GROUP BY ch, nx",
    "bucket_bounds": f"SELECT symbol, CAST(\"end\" - n AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM (SELECT symbol, n, sum(n) OVER (ORDER BY symbol) AS \"end\" FROM (SELECT ch AS symbol, count(*) AS n FROM ({_chars(_C)}) GROUP BY ch))",
    "max_symbol_runs": f"SELECT ch AS symbol, max(n) AS max_run FROM ({_runs(_C)}) GROUP BY ch",
    "suffix_types": f"SELECT doc, idx, type, is_lms FROM ({_types(_B)})", "lms_suffixes": f"SELECT doc, idx FROM ({_types(_C)}) WHERE is_lms",
    "lms_per_symbol": f"SELECT ch AS symbol, count(*) AS n FROM ({_types(_C)}) WHERE is_lms GROUP BY ROLLUP (ch)",
    "lms_names": f"""WITH l AS (SELECT doc, idx, lead(idx) OVER (PARTITION BY doc ORDER BY idx) AS stop FROM ({_types(_P)}) WHERE is_lms),
        s AS (SELECT doc, idx, CASE WHEN stop IS NULL THEN substr(text, CAST(idx + 1 AS INT)) ELSE substr(text, CAST(idx + 1 AS INT), CAST(stop - idx + 1 AS INT)) END AS sub FROM l JOIN ({_P}) USING (doc))
        SELECT doc, idx, CAST(dense_rank() OVER (ORDER BY sub) - 1 AS BIGINT) AS name, count(*) OVER (PARTITION BY sub) = 1 AS is_unique FROM s""",
    "collection_lengths": f"SELECT count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_symbols, max(length(text)) AS max_length FROM ({_D})",
    "reference_augmentation": f"SELECT ch AS symbol, repeat(ch, CAST(max(n) AS INT)) AS run FROM ({_runs(_C)}) WHERE ch NOT IN (SELECT ch FROM ({_chars(_B)})) GROUP BY ch",
    "position_buckets": f"SELECT doc, idx >> 6 AS bucket, count(*) AS n FROM ({_chars(_B)}) GROUP BY ALL",
    "matching_statistics": _MS, "matching_statistics_union": _MS, "ms_heads": _HEADS,
    "parse_stats": f"SELECT doc, count(*) AS n_heads, max(len) AS max_len, CAST(sum(len) AS BIGINT) AS sum_len FROM ({_HEADS}) GROUP BY doc",
    "heads_per_position": f"SELECT pos, count(*) AS n FROM ({_HEADS}) GROUP BY pos",
    "head_rank": _HEAD_RANK,
    "head_sort": f"SELECT CAST(row_number() OVER (ORDER BY isa, side, closeness, next NULLS FIRST, doc, idx) - 1 AS BIGINT) AS rnk, doc, idx FROM ({_KEYS.format(rows=_HEADS)})",
    "head_suffix_array": f"SELECT rnk, doc, k FROM ({_HEAD_SA})",
    "next_head_asof": f"WITH h AS ({_HEADS}) SELECT a.doc, a.idx, b.idx AS next_idx FROM (SELECT doc, idx, idx + len AS q FROM h) a ASOF LEFT JOIN (SELECT doc, idx FROM h) b ON a.doc = b.doc AND a.q >= b.idx",
    "match_order_key": f"""WITH k AS MATERIALIZED ({_KEYS.format(rows=_MS)}), h AS MATERIALIZED ({_HEAD_SA}),
        e AS (SELECT k.doc, k.idx, n.isa AS next_isa, k.idx + k.len AS q FROM k JOIN k n ON n.doc = k.doc AND n.idx = k.idx + k.len),
        c AS (SELECT e.doc, e.idx, e.next_isa, h.rnk AS next_head_rank FROM e ASOF JOIN h ON e.doc = h.doc AND e.q >= h.idx)
        SELECT k.doc, k.idx, k.isa, k.side, k.closeness, c.next_isa, c.next_head_rank FROM k LEFT JOIN c USING (doc, idx)""",
    "match_order": f"SELECT doc, idx, CAST(rank() OVER (ORDER BY suf) - 1 AS BIGINT) AS rank FROM ({_suf(_P)})",
    "heads_order_check": f"""WITH o AS (SELECT rnk, substr(text, CAST(idx + 1 AS INT)) AS suf FROM ({_HEAD_SA}) JOIN ({_P}) USING (doc)),
        p AS (SELECT suf, lag(suf) OVER (ORDER BY rnk) AS before FROM o)
        SELECT count(*) AS n, count(*) FILTER (left(before, CAST(least(length(before), length(suf)) AS INT)) > left(suf, CAST(least(length(before), length(suf)) AS INT))) AS violations FROM p""",
    "interval_widen": f"WITH g AS MATERIALIZED ({_GSA_LCP_N}), i AS ({_INTERVALS}) {_WIDENED}",
    "interval_contract": f"""WITH g AS MATERIALIZED ({_GSA_LCP_N}), j AS (SELECT q, first, last, greatest(depth - 1, 0) AS depth FROM ({_INTERVALS})),
        l AS (SELECT j.q, j.depth, a2.rnk AS first, b2.rnk AS last FROM j JOIN g a ON a.rnk = j.first JOIN g b ON b.rnk = j.last
              LEFT JOIN g a2 ON a2.doc = a.doc AND a2.idx = a.idx + 1 LEFT JOIN g b2 ON b2.doc = b.doc AND b2.idx = b.idx + 1),
        i AS (SELECT * FROM l WHERE first IS NOT NULL AND last IS NOT NULL)
        SELECT * FROM ({_WIDENED}) UNION ALL SELECT q, 0, (SELECT count(*) FROM g) - 1 FROM l WHERE first IS NULL OR last IS NULL""",
    "pattern_count": f"SELECT p.pattern, count(l.doc) AS n FROM (VALUES {_PATTERN_SQL}) p(pattern) LEFT JOIN ({_LOCATE.format(patterns=_PATTERN_SQL, docs=_C)}) l ON p.pattern = l.pattern GROUP BY p.pattern",
    "pattern_locate": _LOCATE.format(patterns=_PATTERN_SQL, docs=_B),
    "backward_count": f"SELECT p.pattern, count(l.doc) AS n FROM (SELECT * FROM {_WORDS} WHERE pattern <> '') p LEFT JOIN ({_FOUND.format(words=_WORDS, docs=_C)}) l ON p.pattern = l.pattern GROUP BY p.pattern",
    "backward_locate": _FOUND.format(words=_WORDS, docs=_B),
    "interval_refine": f"SELECT substr(text, CAST(idx + 3 AS INT), 1) AS extension, min(rnk) AS first, max(rnk) AS last FROM ({_gsa(_B)}) JOIN ({_B}) USING (doc) WHERE substr(text, CAST(idx + 1 AS INT), 2) = 'th' GROUP BY extension",
    "contamination": f"""WITH a AS (SELECT doc, i AS p, substr(text, CAST(i + 1 AS INT), {SHARED}) AS g FROM ({_D}), unnest(range(length(text) - {SHARED - 1})) u(i)),
        b AS (SELECT doc AS item, i AS q, substr(text, CAST(i + 1 AS INT), {SHARED}) AS g FROM ({_B}), unnest(range(length(text) - {SHARED - 1})) u(i)),
        j AS (SELECT doc, item, p - q AS d, p, p - row_number() OVER (PARTITION BY doc, item, p - q ORDER BY p) AS run FROM a JOIN b USING (g))
        SELECT doc, item, max(n) AS len FROM (SELECT doc, item, count(*) + {SHARED - 1} AS n FROM j GROUP BY doc, item, d, run) GROUP BY doc, item""",
    "exact_duplicate_docs": f"SELECT doc, first AS dup_of FROM (SELECT doc, min(doc) OVER (PARTITION BY text) AS first FROM ({_D}) WHERE text <> '') WHERE doc <> first",
    "psv_nsv": f"WITH v AS ({_LCP_N}) SELECT i, coalesce((SELECT max(b.i) FROM v b WHERE b.i <= a.i AND b.value < a.value), -1) AS psv, coalesce((SELECT min(b.i) FROM v b WHERE b.i >= a.i AND b.value < a.value), -1) AS nsv FROM v a",
    "rmq_blocks": f"SELECT i // 16 AS block, min(value) AS least FROM ({_LCP_N}) GROUP BY block",
    "range_minimum": f"WITH v AS ({_LCP_N}) SELECT a.i AS q, min(b.value) AS least FROM v a JOIN v b ON b.i BETWEEN a.i AND a.i + a.i % 50 GROUP BY a.i",
    "int_lcp": f"""SELECT seq, rnk, pos, CAST(coalesce((SELECT min(k) - 1 FROM range(1, 1 + least(len(s), len(b))) r(k) WHERE s[k] <> b[k]), least(len(s), len(b))) AS BIGINT) AS lcp
        FROM (SELECT seq, pos, s, CAST(row_number() OVER w - 1 AS BIGINT) AS rnk, coalesce(lag(s) OVER w, []) AS b FROM ({_INT_SUF}) WINDOW w AS (PARTITION BY seq ORDER BY s))""",
    "int_unbwt_roundtrip": "SELECT CAST(0 AS BIGINT) AS seq, event_id AS pos, CAST(user_id AS BIGINT) AS value FROM events",
    "int_bwt_primary": f"SELECT seq, rnk AS primary FROM (SELECT seq, pos, row_number() OVER (PARTITION BY seq ORDER BY s) AS rnk FROM ({_INT_SUF})) WHERE pos = 0",
    "int_histogram": "SELECT CAST(user_id AS BIGINT) AS value, count(*) AS n FROM events GROUP BY user_id",
    "printable_texts": f"SELECT doc, replace(replace(text, chr(10), '<10>'), chr(9), '<9>') AS text, CAST(floor(log2(length(text))) AS BIGINT) AS bits FROM ({_C})",
    "neighbour_prefixes": f"SELECT a.doc, CAST((SELECT coalesce(max(k), 0) FROM range(1, 1 + least(length(a.text), length(b.text))) r(k) WHERE left(a.text, CAST(k AS INT)) = left(b.text, CAST(k AS INT))) AS BIGINT) AS len FROM ({_P}) a JOIN ({_P}) b ON b.doc = a.doc + 1",
    "marker_counts": f"SELECT count(*) FILTER (v < 0) AS negative, count(*) FILTER (v = 0) AS zero FROM (SELECT lag(idx) OVER (ORDER BY rnk) - idx AS v FROM ({_gsa(_N)}))",
    "gsa_order_check": f"SELECT CAST(sum(length(text)) AS BIGINT) AS n, CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS missing FROM ({_C})",
    "heads_check": f"SELECT CAST(sum(length(text)) AS BIGINT) AS n, CAST(0 AS BIGINT) AS violations FROM ({_P})",
    "fasta_roundtrip": _FASTA,
    "fasta_folder_roundtrip": f"SELECT doc, doc AS header, text FROM ({_FASTA})",
    "fasta_reference_roundtrip": f"SELECT CAST(0 AS BIGINT) AS doc, string_agg(text, '' ORDER BY doc) AS text FROM ({_FASTA})",
    "raw_reference_roundtrip": f"SELECT CAST(0 AS BIGINT) AS doc, string_agg(text, '' ORDER BY doc) AS text FROM ({_FASTA})",
    "raw_collection_roundtrip": f"SELECT row_number() OVER (ORDER BY doc) AS doc, text FROM ({_C})",
    "gsa_records_roundtrip": _gsa(_N),
    "fasta_format_roundtrip": f"SELECT doc, doc AS header, text FROM ({_FASTA})",
    "gsa_format_roundtrip": _gsa(_P),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return ORACLES
