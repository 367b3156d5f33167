"""The operators over the test tables, each beside the SQL that checks it where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, tune
from ..tables import Tables
from . import caps, collocations, decontaminate, language_model, licenses, lines, minhash, packing, render, token_store, toxicity, warc, whitening
from .rows import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(tuned(spark), sf_dir))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return register


def tuned(spark: SparkSession) -> SparkSession:
    """Skew handling, and batches for Python that long texts cannot blow up."""
    given = dict(spark.sparkContext.getConf().getAll())
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in given:
        spark.conf.set(key, str(16 << 20))
    return tune(spark)


@query()
def op1_toxicity(t):
    model = toxicity.train(t.documents, t.labels)
    scored = toxicity.score(t.documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query()
def op2_packing(t):
    pieces = packing.cut(t.documents).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack(pieces)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query(
    r"""
    with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
    g as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
    select page_id, payload_bytes, payload_digest,
           case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
           case when page_id is distinct from first then first end as refers_to
    from p left join g using (payload_digest)
    """
)
def op3_warc(t):
    folder = scratch_dir(t.spark, "warc")
    warc.write(t.pages, folder)
    return warc.read(t.spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    """
    with v as (
      select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
      where label is not null and embedding is not null),
    p as (
      select a.vec_id as a, b.vec_id as b from v a join v b
        on a.label = b.label and a.vec_id < b.vec_id
       and list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98),
    e as (select a, b from p union all select b, a from p),
    r as (
      with recursive r(node, seen) as (
        select vec_id, vec_id from embeddings
        union
        select e.a, r.seen from r join e on e.b = r.node)
      select node, min(seen) as component_id from r group by node)
    select vec_id, (select count(*) from e where e.a = vec_id) as n_links, component_id, vec_id = component_id as kept
    from embeddings join r on r.node = vec_id
    """
)
def op4_cap_filters(t):
    return caps.near_duplicates(t.embeddings)


@query()
def op5_decontamination(t):
    return decontaminate.passages(t.documents, t.benchmark)


@query()
def op6_token_store(t):
    folder = scratch_dir(t.spark, "tokens")
    token_store.write(t.documents, folder)
    return token_store.read(t.spark, folder, with_ids=False)


@query()
def op7_backoff_automaton(t):
    scored = language_model.score(t.documents, fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op8_html_rendering(t):
    return render.render(t.pages.select("page_id", "html"))


@query(
    r"""
    with w as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') as w
      from documents),
    s as (
      select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
      from w),
    p as (
      select a.doc_id as a, b.doc_id as b from s a join s b
        on a.doc_id < b.doc_id and len(a.s) > 0 and len(b.s) > 0 and 100 * least(len(a.s), len(b.s)) >= 80 * greatest(len(a.s), len(b.s))
       and 180 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s))),
    e as (select a, b from p union all select b, a from p),
    r as (
      with recursive r(node, seen) as (
        select doc_id, doc_id from documents
        union
        select e.a, r.seen from r join e on e.b = r.node)
      select node, min(seen) as component_id from r group by node)
    select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join r on r.node = doc_id
    """
)
def op9_minhash_near_dedup(t):
    return minhash.near_duplicates(t.documents, size=2)


@query(
    r"""
    with l as (
      select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
      from documents),
    k as (
      select doc_id, text, line, pos,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
      from l),
    common as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
    select doc_id, count(*) as n_lines, count(*) filter (common.key is not null) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (common.key is null), '')) as kept_sha256
    from k left join common using (key)
    group by doc_id
    """
)
def op10_line_dedup(t):
    kept = lines.drop_common_lines(t.documents.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    r"""
    with p as (
      select coalesce(lang, 'und') as lang,
             unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
      from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
    totals as (select lang, sum(len(w)) as n from w group by lang),
    g as (
      select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
      from w, (values (1), (2), (3), (4), (5)) as sizes(k)
      where len(w) >= k),
    f as (select lang, k, phrase, count(*) as a from g group by lang, k, phrase having count(*) >= 100),
    c as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1),
    cuts as (
      select c.lang, c.k, c.phrase, c.a, c.w, x.a as l, y.a as r, n, split_at, (1000::hugeint * c.a * n) // (x.a::hugeint * y.a) as score
      from c join totals using (lang)
      cross join (values (1), (2), (3), (4)) as cut(split_at)
      join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:split_at], ' ')
      join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[split_at + 1:c.k], ' ')
      where split_at < c.k),
    lowest as (select *, row_number() over (partition by lang, phrase order by score, split_at) as nth from cuts),
    inner_ as (
      select distinct c.lang, array_to_string(c.w[i:j], ' ') as phrase, c.a
      from c cross join (values (1), (2), (3), (4)) as s(i) cross join (values (2), (3), (4), (5)) as e(j)
      where i < j and j <= c.k and j - i + 1 < c.k),
    alive as (
      select * from lowest
      where nth = 1 and not exists (from inner_ where inner_.lang = lowest.lang and inner_.phrase = lowest.phrase and 100 * inner_.a >= 100 * lowest.a)),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from alive)
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000
    """
)
def op12_collocations(t):
    return collocations.mine(t.documents)


@query()
def op13_whitening(t):
    return whitening.whiten(t.embeddings.select("vec_id", "embedding"))


@query()
def op11_license_scan(t):
    return licenses.digest(licenses.find(t.documents.select("doc_id", "text")))
