"""Queries of the operators and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_contamination
from .jaccard import near_groups
from .kdtree import top_k, whole_vectors
from .langid import learn_and_identify
from .line_dedup import build_index, drop_lines
from .merkle import document_manifest, prove
from .packing import pack, placed_pieces
from .substrings import repeated_substrings
from .suffixes import repeated_passages
from .tables import small_batches, table
from .toxicity import score_toxicity
from .urlfilter import filter_urls
from .warc import archive_folder, round_trip
from .whitening import fit_whitening, integer_vectors, whiten

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


OP2 = r"""
with w as (
  select 'd' side, doc_id id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
  union all
  select 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
phrases as (
  select distinct id item_id, list_slice(w, i, i + least(len(w), 10) - 1) p
  from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from w
        where side = 'i' and len(w) > 0)),
sizes as (select distinct len(p) n from phrases),
starts as (
  select id doc_id, i, list_slice(w, i, i + n - 1) p, n
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) i from w, sizes
        where side = 'd' and len(w) >= n)),
hits as (select doc_id, item_id, i, n from starts join phrases using (p)),
marks as (select doc_id, count(distinct k) n_hit
          from (select doc_id, unnest(range(i, i + n)) k from hits) group by 1),
items as (select doc_id, count(distinct item_id) n_items,
                 string_agg(distinct item_id::varchar, ',' order by item_id::varchar) s
          from hits group by 1)
select id doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit,
       coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256,
       coalesce(n_hit, 0) > 0 contaminated
from w left join marks on id = marks.doc_id left join items on id = items.doc_id
where side = 'd'
"""


@query("op2_decontaminate", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return learn_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_pack")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_pieces(pack(table(spark, sf_dir, "documents"))).drop("ids")


REPEATS = r"""
with w as (
  select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w from documents),
windows as (
  select doc_id, i, sha256(array_to_string(list_slice(w, i, i + {k} - 1), ' ')) h
  from (select doc_id, w, unnest(range(1, len(w) - {k} + 2)) i from w where len(w) >= {k})),
firsts as (select h, min(doc_id) first_id from windows group by 1),
hits as (
  select distinct doc_id, unnest(range(i, i + {k})) k
  from windows join firsts using (h) where first_id < doc_id),
words as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) k from w where len(w) > 0),
kept as (
  select doc_id, string_agg(word, ' ' order by k) s
  from words anti join hits using (doc_id, k) group by 1),
removed as (select doc_id, count(*) n from hits group by 1)
select doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(n, 0)::bigint n_removed,
       sha256(coalesce(s, '')) kept_sha256
from w left join removed using (doc_id) left join kept using (doc_id)
"""


@query("op9_suffix_array_dedup", REPEATS.format(k=50))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


@query("op10_substring_dedup", REPEATS.format(k=13))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).drop("spans")


OP6 = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (
  select page_id, strlen(h)::bigint payload_bytes, h,
         array_to_string(list_transform(range(32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(sha1(h), 5 * (i // 4) + 1, 5))::int
                 >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') payload_digest
  from p),
f as (select h, min(page_id) first_id from p group by 1)
select page_id, payload_bytes, payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end record_type,
       case when page_id <> first_id then first_id end refers_to
from d join f using (h)
"""


@query("op6_warc", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), archive_folder(spark))


OP1 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select q.vec_id query_id, row_number() over (
         partition by q.vec_id order by list_dot_product(q.v, c.v) desc, c.vec_id)::int rank,
       c.vec_id, list_dot_product(q.v, c.v)::bigint score
from v q join v c on q.vec_id <> c.vec_id
where q.vec_id % 20 = 0
qualify rank <= 20
"""


@query("op1_topk", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("id % 20 = 0"), vectors, 20)


OP8 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, sha256(array_to_string(list_slice(w, i, i + 4), ' ')) h
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
links as (
  select a.doc_id a, b.doc_id b from s a join s b on a.h = b.h and a.doc_id <> b.doc_id
  group by 1, 2
  having 100 * count(*) >= 75 * ((select n from n where doc_id = a.doc_id)
                               + (select n from n where doc_id = b.doc_id) - count(*))),
reach as (
  select doc_id, doc_id c from n
  union
  select b, c from reach join links on doc_id = a)
select doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(c, doc_id) component_id
from w left join n using (doc_id)
left join (select doc_id, min(c) c from reach group by 1) using (doc_id)
"""


@query("op8_jaccard_join", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LEVEL = """
c{k} as (select right(gram, {k} + 1) own, sum(a) a, sum(r) r from counts group by 1),
n{k} as (select own, a, r, sum(a) over w ta, sum((a > 0)::int) over w ka,
                sum(r) over w tr, sum((r > 0)::int) over w kr
         from c{k} window w as (partition by substr(own, 1, {k}))),
p{k} as (select own,
           case when ta > 0 then (a + ka * {la}) / (ta + ka) else {la} end pa,
           case when tr > 0 then (r + kr * {lr}) / (tr + kr) else {lr} end pr
         from n{k} {join}),"""
_LEVELS = _LEVEL.format(k=0, la="(1.0::double / 256)", lr="(1.0::double / 256)", join="") + "".join(
    _LEVEL.format(
        k=k, la="low.pa", lr="low.pr",
        join=f"join (select own shorter, pa, pr from p{k - 1}) low on right(own, {k}) = shorter",
    )
    for k in range(1, 5)
)
OP7 = f"""
with pg as (select page_id, coalesce(url, '') url from pages),
parts as (
  select page_id, url, case when contains(url, '://')
                       then substr(url, instr(url, '://') + 3) else '' end rest from pg),
hp as (
  select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from parts),
rules(ruled, rh, rp) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best as (
  select url, max_by(rh || rp, length(rh || rp)) rule, max_by(ruled, length(rh || rp)) ruled
  from (select distinct url, host, path from hp), rules
  where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1),
u as (
  select url, n, ruled, substr(md5(url), 1, 1) in ('0', '1', '2') held
  from (select url, count(*) n from pg group by 1) left join best using (url)),
g as (
  select url, n, ruled, held, substr(repeat(chr(2), 4) || url || chr(3), i, 5) gram
  from (select *, unnest(range(1, length(url) + 2)) i from u)),
counts as (
  select gram, sum(case when not held and ruled = 'allow' then n else 0 end) a,
         sum(case when not held and ruled = 'block' then n else 0 end) r
  from g group by 1),
{_LEVELS}
model as (select own gram, round((ln(pa) - ln(pr)) * 1e6)::bigint ratio from p4),
s as (select url, any_value(n) n, any_value(ruled) ruled, any_value(held) held,
             sum(ratio) / count(*)::double score
      from g join model using (gram) group by 1),
k as (select ruled, sum(score * n) / sum(n) m, sum(score * score * n) / sum(n) q
      from s where held and ruled is not null group by 1),
v as (select max(case when ruled = 'allow' then m end) ma, max(case when ruled = 'block' then m end) mr,
             max(case when ruled = 'allow' then sqrt(greatest(q - m * m, 0)) end) sa,
             max(case when ruled = 'block' then sqrt(greatest(q - m * m, 0)) end) sr
      from k where (select count(distinct ruled) from s where not held) = 2),
t as (select coalesce(case when sa + sr = 0 then (ma + mr) / 2 else (ma * sr + mr * sa) / (sa + sr) end,
                      '-infinity'::double) t from v)
select page_id, host, path, rule,
       coalesce(best.ruled, case when score >= t then 'allow' else 'block' end) verdict
from hp join s using (url) left join best using (url), t
"""


@query("op7_url_filter", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("score")


OP11 = r"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
e as (select r, doc_id, unnest(l) line, unnest(range(1, len(l) + 1)) i from d),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') own from e),
f as (select own from k where length(own) >= 1 group by own having count(distinct r) >= 10)
select doc_id, count(*) n_lines, count(f.own) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.own is null), '')) kept_sha256
from k left join f using (own)
group by r, doc_id
"""


@query("op11_line_dedup", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, build_index(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def _nibbles() -> str:
    """The table of a CRC-32 that takes four bits a step, as a list in SQL."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return "[" + ", ".join(f"{x}::bigint" for x in out) + "]"


_LEVELS_SQL = """
{name} as (
  select {tree} tree, 0 lvl, {pos} pos, {h} h, {n} n from {rows}
  union all
  select tree, lvl + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (n + 7) // 8
  from {name} where n > 1 group by tree, lvl, pos // 8, n),
{name}_runs as (select tree, lvl, pos // 8 pos, list(h order by pos) hs from {name} where n > 1
                group by tree, lvl, pos // 8),"""
_CLIMB_SQL = """
{name} as (
  select doc_id, leaf, {tree} tree, 0 lvl, {pos} pos, {n} n, {f} f, {p} p from {rows}
  union all
  select doc_id, leaf, c.tree, c.lvl + 1, c.pos // 8, (n + 7) // 8,
         sha256(array_to_string(hs[1:c.pos % 8] || [f] || hs[c.pos % 8 + 2:], '')),
         p || array_to_string(hs[1:c.pos % 8] || hs[c.pos % 8 + 2:], '')
  from {name} c join {levels}_runs r on c.tree = r.tree and c.lvl = r.lvl and c.pos // 8 = r.pos
  where c.n > 1),"""
_FRAMES = {x: f"coalesce(strlen({x}::varchar) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars")}
OP13 = f"""
with recursive
crc as (
  select doc_id, lang, source, n_chars, text,
         xor(list_reduce(flatten([[4294967295::bigint], flatten(list_transform(
               string_split(doc_id::varchar, ''), lambda s: [(ascii(s) & 15)::bigint, (ascii(s) >> 4)::bigint]))]),
             lambda c, x: xor(c >> 4, ({_nibbles()})[(xor(c, x) & 15) + 1])), 4294967295) % 3 = 0 hit
  from documents),
hashed as (
  select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf,
         sha256(head || coalesce(strlen(given) || ':' || given, '-')) given
  from (select *, {" || ".join(_FRAMES.values())} head,
               case when hit then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz') else text end given from crc)),
leaves as (
  select *, dense_rank() over (order by lang nulls first) - 1 tree,
         row_number() over (partition by lang order by doc_id) - 1 pos, count(*) over (partition by lang) n
  from hashed),
{_LEVELS_SQL.format(name="low", tree="tree", pos="pos", h="leaf", n="n", rows="leaves")}
subs as (select tree, h, count(*) over () n from low where n = 1),
{_LEVELS_SQL.format(name="high", tree="0::bigint", pos="tree", h="h", n="n", rows="subs")}
{_CLIMB_SQL.format(name="up", tree="tree", pos="pos", n="n", f="given", p="''", rows="leaves", levels="low")}
arrived as (select doc_id, leaf, up.tree, f, p, subs.n, subs.h from up join subs using (tree) where up.n = 1),
{_CLIMB_SQL.format(name="top", tree="0::bigint", pos="tree", n="n", f="f", p="p", rows="arrived", levels="high")}
root as (select h root from high where n = 1)
select doc_id, leaf, h subroot, root, sha256(top.p) proof_sha256, top.f folded_root, top.f = root verified
from top join arrived using (doc_id, leaf), root where top.n = 1
"""


@query("op13_merkle", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prove(document_manifest(table(spark, sf_dir, "documents")))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), 256)
    return whiten(vectors, fit_whitening(vectors))
