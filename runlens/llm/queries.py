"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (line_templates, mixing, order_minhash, packing, periodic_runs, prefix_trie, quality, secret_spans, simhash_grid,
               spotsigs, token_attribution, token_shards, warc)
from .common import WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents
), s as (
  select source, sum(size)::bigint source_size, 2.0::double * sum(size)::bigint cap,
         [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double weight
  from d group by source
), l as (
  select *, (1.5::double * (sum(source_size) over ())::bigint
             - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over ()
               - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) lev,
         row_number() over (order by cap / weight, source nulls last) k
  from s
), t as (
  select source, source_size,
         case when lev * weight >= cap then cap
              else weight * (min_by(lev, k) filter (lev * weight < cap) over ()) end target
  from l
), w as (
  select d.doc_id, d.source, d.size, t.source_size, t.target, md5('mix-1|' || coalesce(d.doc_id::varchar, 'null')) draw,
         case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end whole,
         d.size * 200 > t.source_size large
  from d join t on d.source is not distinct from t.source
), b as (
  select *, target - whole * source_size wanted,
         coalesce(sum(size) over (partition by source, large order by draw, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint before,
         (sum(size) over (partition by source, large))::bigint stratum
  from w
), g as (
  select *, large and before + size / 2.0::double <= wanted / source_size * stratum more from b
), r as (
  select *, (coalesce(sum(size) filter (large and more) over (partition by source), 0))::bigint large_taken from g
)
select doc_id, size, source_size, target,
       case when size = 0 then 0 else
         size * least(2, whole + (case when large then more else before + size / 2.0::double <= wanted - large_taken end)::bigint) end::bigint taken
from r
"""


@query("op1_mixture", MIX_SQL)
def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mixing.repetitions(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return r.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"),
                    F.explode(F.sequence(F.lit(1), F.col("n"))).alias("row")).drop("row")


@query("op2_quality_divergence")
def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judge(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept", "char_distance", "word_distance")


@query("op3_bestfit_packing")
def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_spotsigs")
def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_secret_spans")
def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.digests(secret_spans.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


WARC_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, octet_length(encode(html))::bigint payload_bytes, sha1(html) payload_digest from p),
r as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes >= 1000)
              else page_id end first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end record_type,
       case when page_id <> first then first end refers_to
from r
"""


@query("op10_warc_bundles", WARC_SQL)
def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html")), payloads=False)


@query("op6_line_templates")
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = line_templates.without_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("row.doc_id", F.size(F.split("row.text", "\n", -1)).cast("bigint").alias("n_lines"),
                    F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
                    F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped_lines"),
                    F.coalesce(F.array_join("passages", ","), F.lit("")).alias("dropped_passages"),
                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op7_order_minhash")
def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "label")


@query("op5_token_shards")
def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.segments(token_shards.write(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op8_token_attribution")
def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.attribute(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_simhash_grid")
def op12_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash_grid.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def crc32_sql(number: str) -> str:
    """DuckDB SQL: unsigned CRC-32 of a number's decimal text."""
    byte = "list_transform(range(1, len(s) + 1), lambda i: ord(s[i])::bigint)"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    return f"(select xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: {step}), 4294967295) from (select ({number})::varchar s))"


TRIE_SQL = rf"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) pos
  from conversations where conv_id is not null
), n as (
  select conv_id, count(*) n, conv_id - conv_id % 20 base from t group by conv_id
), c as materialized (
  select n.conv_id, n.base, h, least(h, coalesce(b.n, 0)) head
  from (select *, {crc32_sql('conv_id')} % 4 h from n) n left join n b on b.conv_id = n.base
), r as materialized (
  select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.base and t.pos <= c.head
  union all
  select c.conv_id, t.pos - c.h + c.head, t.role, t.text from c join t on t.conv_id = c.conv_id and t.pos > c.h
), p as materialized (
  select conv_id, pos d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) w,
         sha256(string_agg(len(role) || ':' || role || len(text) || ':' || text, '' order by pos) over (partition by conv_id order by pos)) k
  from (select * from r) x
  union all
  select conv_id, 0, 0, '' from c
), m as (
  select conv_id, max(d) m from p group by conv_id
), e as (
  select p.d, p.k, string_agg(p.conv_id::varchar, ',' order by p.conv_id) listed from p join m on m.conv_id = p.conv_id and m.m = p.d group by p.d, p.k
), q as materialized (
  select d, k, min(conv_id) conv_id, count(*) n_convs, any_value(w) w from p group by d, k
), u as materialized (
  select q.*, a.k parent_k, a.conv_id parent_conv_id
  from q left join p on p.conv_id = q.conv_id and p.d = q.d - 1 left join q a on a.d = p.d and a.k = p.k
), kids as (
  select d - 1 d, parent_k k, count(*) n_children from u where d > 0 group by all
), v as materialized (
  select u.*, coalesce(n_children, 0) n_children from u left join kids on kids.d = u.d and kids.k = u.k
), totals as (
  select p.d, p.k, sum((v.n_convs - 1) * v.w) saved, sum((v.n_children = 0)::int) leaves
  from v join p on p.conv_id = v.conv_id and p.d <= v.d group by p.d, p.k
)
select v.conv_id, v.d::bigint depth, v.parent_conv_id, v.n_convs, v.n_children::bigint n_children, leaves::bigint n_leaves, saved::bigint saved_tokens,
       sha256(coalesce(listed, '')) ends_sha256
from v join totals t on t.d = v.d and t.k = v.k left join e on e.d = v.d and e.k = v.k
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.positions(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.trie(*prefix_trie.with_shared_heads(turns, every=20, heads=4))


PERIODIC_SQL = rf"""
with d as materialized (
  select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, {crc32_sql('doc_id')} h from documents
), g as (
  select rid, doc_id, w, len(w) n, h // 10 g, h % 10 = 0 and len(w) > 0 made from d
), r as (
  select *, case when made then g % n end a, case when made then 1 + (n - g % n) // (3 + g % 8) end p from g
), x as materialized (
  select rid, doc_id, n, case when made then list_transform(range(n), lambda i: w[(case when i < a then i else a + (i - a) % p end) + 1]) else w end w from r
), t as materialized (
  select rid, n, unnest(w) word, unnest(range(n)) i from x
), q as (
  select b.rid, b.i, b.i - a.i q from t a join t b on a.rid = b.rid and a.word = b.word and a.i < b.i and 4 * (b.i - a.i) <= a.n
), s as (
  select rid, q, min(i) - q as start, count(*) + q as length
  from (select *, i - row_number() over (partition by rid, q order by i) island from q) y group by rid, q, island
), u as materialized (
  select rid, start, length, min(q) period from s where length >= greatest(6, 4 * q) group by rid, start, length
), agg as (
  select rid, count(*) n_runs, min_by(struct_pack(start, length, period), struct_pack(l := -length, s := start, p := period)) best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) listed
  from u group by rid
), gone as (
  select distinct rid, unnest(range(start + period, start + length)) i from u
), c as (
  select rid, string_agg(word, ' ' order by i) kept from t anti join gone using (rid, i) group by rid
)
select doc_id, coalesce(n_runs, 0)::bigint n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period,
       (1000 * best.length // best.period)::bigint exponent_milli, sha256(coalesce(listed, '')) runs_sha256, sha256(coalesce(kept, '')) collapsed_sha256
from x left join agg using (rid) left join c using (rid)
"""


@query("op13_periodic_runs", PERIODIC_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    # a tenth of the documents is made periodic from word a on, with period p
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    docs = docs.withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("bigint"))).withColumn("g", F.floor(F.col("h") / 10))
    docs = docs.withColumn("a", F.col("g") % F.col("n"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, rest = F.col("a").cast("int"), (F.col("n") - F.col("a")).cast("int")
    root = F.slice("w", a + 1, F.col("p"))
    made = F.concat(F.slice("w", F.lit(1), a), F.slice(F.flatten(F.array_repeat(root, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest))
    found = periodic_runs.detect(docs.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(F.array_join(made, " ")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", longest)
    start, length, period = -F.col("best.s"), F.col("best.length"), -F.col("best.p")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"),
                        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
