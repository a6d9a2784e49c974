"""The operators' registered queries: thin, over whole tables, with production parameters; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import byte_bpe, chat, lines, mixture, neardup, quality, substrings, topk, urls, warc
from larkspur.llm.common import cut
from larkspur.session import ship_package

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), urls.default_model()).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    index = warc.build_index(warc.write_archives(pages))
    return warc.fetch_captures(index, pages.select(warc.url_key(F.col("url")).alias("key"), "page_id")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(_table(spark, sf_dir, "documents").select("doc_id", "source", mixture.word_count(F.col("text")).alias("size")))
    mixed = mixture.mix(docs, mixture.plan_mixture(docs, size_col="size"), size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), F.array_join("copies", ",").alias("shards"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.read_whole(chat.render_turns(turns.unionByName(extra)))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_texts(_table(spark, sf_dir, "documents"), RANKS, PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter, "op2_quality_rules": op2_quality_rules, "op3_warc": op3_warc, "op4_mixture": op4_mixture, "op5_chat": op5_chat, "op6_near_dedup": op6_near_dedup, "op7_line_dedup": op7_line_dedup, "op8_byte_bpe": op8_byte_bpe,
        "op9_top_k": op9_top_k, "op10_substring_dedup": op10_substring_dedup,
    }


def _url_sql() -> str:
    model = urls.default_model()
    half = len(model.weights) // 2

    def grams(text: str, mark: int) -> str:
        codes = f"list_concat(list_concat([{mark}::bigint], list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: unicode(c)::bigint)), [{mark}::bigint])"
        parts = []
        for n in urls.SIZES:
            h = f"{mark}::bigint"
            for k in range(n):
                h = f"(({h} * {urls._BASE} + x.c[i + {k}]) % {urls._PRIME})"
            parts.append(f"coalesce(list_sum(list_transform(range(1, len(x.c) - {n} + 2), lambda i: x.w[1 + {h} % {half} + {half if mark == 3 else 0}])), 0)")
        return f"list_transform([{{'c': {codes}, 'w': w.w}}], lambda x: {' + '.join(parts)})[1]"

    rules = sorted(urls.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in rules]
    name = "case " + " ".join(f"when {f} then '{h + p}'" for f, (h, p, _) in zip(fits, rules, strict=True)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for f, (*_, v) in zip(fits, rules, strict=True)) + " when score > 0 then 'block' else 'allow' end"
    return f"""
with w as (select [{','.join(map(str, model.weights))}]::bigint[] as w),
parts as (select page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
scored as (select page_id, host, path, ({model.bias} + {grams('host', 2)} + {grams('path', 3)})::bigint as score from parts, w)
select page_id, host, path, {name} as rule, {verdict} as verdict, score from scored"""


def _quality_sql() -> str:
    r = quality.Rules()
    lengths = sorted({r.base_window, *r.coverage})
    marked = []
    for n in lengths:
        marked.append(f"""g{n} as (select k, i, md5(list_aggregate(w[i:i + {n - 1}], 'string_agg', ' ')) as h from (select k, w, unnest(range(1, len(w) - {n - 2})) as i from d where len(w) >= {n})),
m{n} as (select distinct k, unnest(range(i, i + {n})) as j from (select k, i, count(*) over (partition by k, h) as c from g{n}) where c > 1),
r{n} as (select m{n}.k, count(*) as words, sum(length(d.w[j])) as chars from m{n} join d using (k) group by m{n}.k)""")
    share = lambda n: f"(coalesce(r{n}.chars, 0)::double / greatest(word_chars, 1))"
    dup = "(coalesce(dup_chars, 0)::double / greatest(coalesce(line_chars, 0), 1))"
    failed = f"(n_words < {r.min_words} or 100 * coalesce(r{r.base_window}.words, 0) > {r.base_percent} * n_words)"
    fine = " and ".join([*(f"{share(n)} <= {x}" for n, x in sorted(r.coverage.items())), f"{dup} <= {r.duplicate_lines}", f"n_symbols <= {r.symbols} * n_words"])
    return rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
{", ".join(marked)},
l as (select k, line, row_number() over (partition by k, line) as nth from (select k, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
x as (select k, count(*) filter (nth > 1) as dups, sum(length(line)) filter (nth > 1) as dup_chars, sum(length(line)) as line_chars from l group by k),
b as (select k, doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols from d)
select doc_id, n_words, word_chars, n_symbols, coalesce(dups, 0)::bigint as n_dup_lines, coalesce(r{r.base_window}.words, 0)::bigint as n_repeat_words,
    {", ".join(f"{share(n)} as coverage_{n}" for n in sorted(r.coverage))}, {dup} as dup_line_share, {failed} as base_failed, not {failed} and {fine} as kept
from b left join x using (k) {" ".join(f"left join r{n} using (k)" for n in lengths)}"""


def _mixture_sql() -> str:
    blocks, shards, seed = mixture.BLOCKS, mixture.SHARDS, 7
    weights = "case (row_number() over (order by source is null, encode(source))) % 3 when 1 then 5.0 when 2 then 2.0 else 1.0 end::double"
    levels = (shards - 1).bit_length()
    tree = []
    for n in range(levels):
        at = f"select *, (lo + hi) // 2 as mid, all_balls * ((lo + hi) // 2) // {shards} - all_balls * lo // {shards} as room, row_number() over (partition by lo, hi order by md5('{seed}:{n}:' || k || ':' || j), k, j) as nth from n{n}"
        tree.append(f"n{n + 1} as (select k, j, all_balls, case when hi - lo = 1 or nth <= room then lo else mid end as lo, case when hi - lo = 1 or nth > room then hi else mid end as hi from ({at}))")
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        (('0x' || substr(md5('{seed}:' || doc_id), 1, 8))::bigint & 2147483647) as place from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select source, source_size, {weights} as weight, row_number() over (order by source is null, encode(source)) - 1 as idx from s),
r as (select *, row_number() over (order by 3 * source_size / weight, weight) as k, sum(source_size) over () as total from w),
c as (select *, coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0)::double as capped,
        sum(weight) over (order by k rows between current row and unbounded following) as open_weight from r),
l as (select min(k) filter (3 * source_size >= (total - capped) * weight / open_weight) as first_open from c),
o as (select first(capped) as capped, first(open_weight) as open_weight from c, l where k = first_open),
t as (select source, idx, source_size, total, case when k < first_open then 3.0 * source_size else (total - o.capped) * weight / o.open_weight end::double as target from c, l, o),
u as (select *, case when source_size = 0 then 0 else least(3, floor(target / source_size)) end::bigint as passes, case when total = 0 then 1 else greatest(1, least({blocks}, {blocks} * source_size // total)) end::bigint as n_blocks from t),
p as (select d.doc_id, d.size, u.*, target - passes * source_size as rest, (place * n_blocks) >> 31 as block,
        sum(d.size) over (partition by d.source order by d.place, d.doc_id rows between unbounded preceding and current row) as upto
    from d join u on d.source is not distinct from u.source),
e as (select idx, min(block) as edge from (select idx, block, rest, passes, sum(sum(size)) over (partition by idx order by block) as cum from p group by idx, block, rest, passes) where cum >= rest and rest > 0 and passes < 3 group by idx),
q as (select idx as k, (passes * n_blocks + coalesce(edge + 1, 0))::bigint as quota from u left join e using (idx)),
n0 as (select k, unnest(range(quota)) as j, (select sum(quota) from q)::bigint as all_balls, 0 as lo, {shards} as hi from q),
{", ".join(tree)},
b as (select k, j, row_number() over (partition by k order by md5('{seed}:block:' || k || ':' || j), j) as nth from n0),
f as (select k, lo as shard, sum(count(*)) over (partition by k order by lo) as upto, count(*) as n from n{levels} group by k, lo),
x as (select b.k, b.j, f.shard from b join f on b.k = f.k and b.nth <= f.upto and b.nth > f.upto - f.n),
y as (select p.*, unnest([0, 1, 2]) as pass from p),
z as (select doc_id, pass, x.shard from y join x on y.idx = x.k and x.j = pass * n_blocks + block where pass < passes or (pass = passes and upto - size / 2 <= rest and rest > 0)),
m as (select doc_id, count(*) as n, string_agg(shard::varchar, ',' order by pass) as shards from z group by doc_id)
select doc_id, size, source_size, target, (size * coalesce(n, 0))::bigint as taken, coalesce(shards, '') as shards from p left join m using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    escaped = r"regexp_replace({}, '(\\|###|</turn>)', '\\\1', 'g')"
    return {
        "op1_url_filter": _url_sql(),
        "op2_quality_rules": _quality_sql(),
        "op3_warc": """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as n, sha1(coalesce(html, '')) as h from pages),
f as (select h, max(page_id) as top from p where n >= 1000 group by h)
select p.page_id, p.n as payload_bytes, p.h as payload_digest, case when p.n >= 1000 and p.page_id < f.top then 'revisit' else 'response' end as record_type,
    case when p.n >= 1000 and p.page_id < f.top then f.top end as refers_to from p left join f on p.h = f.h""",
        "op4_mixture": _mixture_sql(),
        "op5_chat": rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s as (select *, 4 + length({escaped.format('role')}) + 2 + length({escaped.format('text')}) + 9 as chars from c),
e as (select *, sum(chars) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as upto from s)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    coalesce(sum(upto) filter (role = 'assistant'), 0)::bigint as formatted_chars from e group by conv_id""",
        "op7_line_dedup": rf"""
with l as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
h as (select source, count(*) as pages from documents group by source),
b as (select source, line, count(distinct doc_id) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by source, line),
x as (select b.source, b.line from b join h on b.source is not distinct from h.source where n >= {lines.MIN_PAGES} and n > {lines.RATIO} * pages),
k as (select l.*, x.line is not null as gone, regexp_matches(l.line, '[^\x20\x09-\x0D]') as worded from l left join x on l.source is not distinct from x.source and l.line = x.line),
a as (select doc_id, count(*) filter (worded) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as kept from k group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, length(kept)::bigint as kept_chars, sha256(kept) as kept_sha256 from documents d left join a using (doc_id)""",
        "op9_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
        "op10_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
h as (select doc_id, i, md5(list_aggregate(w[i:i + 49], 'string_agg', ' ')) as k from g),
m as (select k, min(doc_id) as low from h group by k),
r as (select distinct doc_id, unnest(range(i, i + 50)) as j from h join m using (k) where low < doc_id),
x as (select doc_id, list(j) as gone, count(*) as n from r group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
    sha256(coalesce(list_aggregate(list_filter(w, lambda v, j: n is null or not list_contains(gone, j)), 'string_agg', ' '), '')) as kept_sha256
from d left join x using (doc_id)""",
    }
