"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import alignment, decontaminate, exact_dedup, language_id, line_dedup, minhash, mixing, ranked_search, repeats, simhash, token_output, url_filter, warc
from kerbline.llm.common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return warc.read_records(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path(), special_text=False)
    return token_output.document_index(spark, path)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), keep_text=False)
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def held_out(doc_id):
    """Documents that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.identify(docs.select("doc_id", "text"), model, keep_text=False)
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", url_filter.host_of(F.col("url")).alias("host"), line_dedup.html_text(F.col("html")).alias("text"))
    kept = F.coalesce(F.col("kept_text"), F.lit(""))
    return line_dedup.drop_boilerplate(pages).select(
        F.col("row.page_id").alias("page_id"),
        F.col("row.host").alias("host"),
        "n_lines",
        "n_dropped",
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(_table(spark, sf_dir, "documents"))
    return ranked_search.search(index, _table(spark, sf_dir, "benchmark"), k=50)


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.cross_align(_table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_mix_sources, op3_simhash, op4_url_filter, op5_exact_dedup,
        op6_token_output, op7_decontaminate, op8_remove_repeats, op9_language_id, op10_line_dedup,
        op11_minhash, op12_ranked_search, op13_cross_tokens,
    )
}

_SQL_OP5 = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""

_SQL_OP10 = rf"""
with texts as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         string_split(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)) as ls
  from pages),
lines as (select page_id, host, unnest(range(len(ls))) as pos, unnest(ls) as line from texts),
totals as (select host, count(*) as total from texts group by host),
boiler as (
  select l.host, l.line from lines l join totals t using (host)
  where trim(l.line) <> '' group by l.host, l.line, t.total
  having count(distinct page_id) >= {line_dedup.MIN_PAGES} and count(distinct page_id) > {line_dedup.RATIO}::double * t.total),
marked as (
  select l.*, b.line is not null as gone from lines l left join boiler b on l.host = b.host and l.line = b.line),
kept as (
  select page_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
         sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
  from marked group by page_id)
select t.page_id, t.host, coalesce(k.n_lines, 0)::int as n_lines, coalesce(k.n_dropped, 0)::int as n_dropped,
       coalesce(k.kept_sha256, sha256('')) as kept_sha256
from texts t left join kept k on t.page_id = k.page_id
"""

_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, {a}, 5))::int >> {s}) & 31), 1)"
_SHA1_B32 = " || ".join(_B32.format(a=g * 5 + 1, s=s) for g in range(8) for s in (15, 10, 5, 0))
_SQL_OP1 = f"""
with h as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as d from pages)
select page_id, octet_length(encode(body))::bigint as payload_bytes, {_SHA1_B32} as payload_digest,
       case when page_id = max(page_id) over (partition by body) then 'response' else 'revisit' end as record_type,
       case when page_id = max(page_id) over (partition by body) then null else max(page_id) over (partition by body) end as refers_to,
       true as verified
from h
"""


def _sql_op4() -> str:
    rule, verdict = "cast(null as varchar)", "cast(null as varchar)"
    for h, p, v in sorted(url_filter.RULES, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
        rule, verdict = f"case when {fits} then '{h + p}' else {rule} end", f"case when {fits} then '{v}' else {verdict} end"
    alpha = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    sql = rf"""
with marks as (
  select doc_id, max(case when toxic = 1 or quality = 0 then 1 when toxic is not null or quality is not null then 0 end) as b
  from labels where doc_id is not null group by doc_id),
p0 as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {alpha}) as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         case when b is null then 0 else 1 end as labelled, coalesce(b, 0) as bad
  from pages left join marks on page_id = doc_id),
t0 as (
  select host, path, sum(labelled)::double as labelled, sum(bad)::double as bad,
         list_filter(string_split(path, '/'), lambda s: s <> '') as segments, '' as template
  from p0 group by host, path)"""
    z2 = url_filter.MIN_Z**2

    def apart(b1, n1, b2, n2):
        return (f"(pow(({b1} + 1) / ({n1} + 2) - ({b2} + 1) / ({n2} + 2), 2) > {z2} * (({b1} + {b2} + 1) / ({n1} + {n2} + 2)"
                f" * (1 - ({b1} + {b2} + 1) / ({n1} + {n2} + 2)) * (1 / ({n1} + 2) + 1 / ({n2} + 2))))")

    for d in range(1, url_filter.DEPTH + 1):
        sql += rf""",
r{d} as (select *, case when regexp_matches(segments[{d}], '[0-9]') then '*' else segments[{d}] end as seg from t{d - 1}),
c{d} as (select host, template, seg, sum(labelled) as cl, sum(bad) as cb from r{d} where seg is not null group by all),
n{d} as (select host, template, sum(cl) as nl, sum(cb) as nb from c{d} group by all),
x{d} as (select *, case when seg <> '*' and {apart('cb', 'cl', '(nb - cb)', '(nl - cl)')} then floor((cb + 1) / (cl + 2) * {url_filter.BINS}) end as bin
         from c{d} join n{d} using (host, template)),
g{d} as (select host, template, bin, sum(cl) as n, sum(cb) as b, min(seg) as first, count(*) as children from x{d} where bin is not null group by all),
h{d} as (select *, case when lag(n) over w is null or {apart('b', 'n', 'lag(b) over w', 'lag(n) over w')} then 1 else 0 end as new from g{d} window w as (partition by host, template order by bin)),
i{d} as (select *, sum(new) over (partition by host, template order by bin) as branch from h{d}),
m{d} as (select host, template, bin, min(first) over w || case when sum(children) over w > 1 then '#' else '' end as nxt from i{d} window w as (partition by host, template, branch)),
s{d} as (select host, template, seg, coalesce(nxt, '*') as nxt from x{d} left join m{d} using (host, template, bin)),
t{d} as (select r.host, r.path, r.labelled, r.bad, r.segments,
                case when r.seg is null then r.template else r.template || '/' || s.nxt end as template
         from r{d} r left join s{d} s on r.host = s.host and r.template = s.template and r.seg = s.seg)"""
    d = url_filter.DEPTH
    return sql + f""",
tree as (select host, path, labelled, bad, template || case when len(segments) > {d} then '/**' else '' end as template from t{d}),
prior as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(labelled), 0) + 2)::double as p from p0),
judged as (
  select host, template, case when sum(labelled) >= {url_filter.MIN_LABELS}
      and (sum(bad) + {url_filter.PRIOR} * any_value(p)) / (sum(labelled) + {url_filter.PRIOR}) >= {url_filter.THRESHOLD}
      then 'block' else 'allow' end as learned
  from tree cross join prior group by host, template)
select page_id, host, path, {rule} as rule, coalesce({verdict}, learned) as verdict, template
from p0 join tree using (host, path) join judged using (host, template)
"""


_SQL_OP12 = r"""
with words as (select doc_id, rowid_, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws
  from (select *, row_number() over () as rowid_ from documents)),
terms as (select doc_id, rowid_, len(ws)::bigint as n, unnest(ws) as term from words),
total as (select count(*)::bigint as nn, coalesce(sum(len(ws)), 0)::bigint as l from words where len(ws) > 0),
tfs as (select doc_id, rowid_, n, term, count(*)::bigint as tf from terms group by all),
dfs as (select term, count(*)::bigint as df from tfs group by term),
items as (select item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term
  from (select distinct item_id, text from benchmark)),
scored as (
  select i.item_id, i.text, t.rowid_, t.doc_id, sum(floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l))))::bigint as score
  from items i join tfs t using (term) join dfs using (term) cross join total group by all),
ranked as (select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""


ORACLE_SQL = {
    "op1_warc": _SQL_OP1,
    "op4_url_filter": _sql_op4(),
    "op5_exact_dedup": _SQL_OP5,
    "op10_line_dedup": _SQL_OP10,
    "op12_ranked_search": _SQL_OP12,
}
