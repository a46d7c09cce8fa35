"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import contamination_report
from .exact_dedup import dedup_report
from .language_id import language_report
from .licenses import license_report
from .licenses import oracle_sql as license_sql
from .line_dedup import line_report
from .mixing import mix
from .ngram_join import near_report
from .packing import packing_report
from .periodic_runs import plant_runs, runs_report
from .pii import pii_report
from .prefix_trie import oracle_sql as trie_sql
from .prefix_trie import trie_report
from .token_counts import token_counts
from .token_files import token_file_report

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _on(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": lambda spark, sf_dir: contamination_report(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ),
    "op2_pii": _on("documents", pii_report),
    "op3_license_scan": _on("documents", license_report),
    "op4_line_dedup": _on("documents", line_report),
    "op5_packing": _on("documents", packing_report),
    "op6_exact_dedup": _on("documents", dedup_report),
    "op7_ngram_join": _on("documents", near_report),
    "op8_language_id": _on("documents", language_report),
    "op9_token_counts": _on("documents", token_counts),
    "op10_token_files": _on("documents", token_file_report),
    "op11_mixing": _on("documents", mix),
    "op12_prefix_trie": _on("conversations", trie_report),
    "op13_periodic_runs": _on("documents", lambda docs: runs_report(plant_runs(docs))),
}

# Words and windows of op1; windows of all lengths that occur are compared.
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        with items as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
        runs as (
            select distinct item, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as run, least(10, len(w)) as n
            from (select *, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)
        ),
        docs as (select doc_id, {_WORDS} as w from documents),
        places as (
            select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as run
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
                  from docs, (select distinct n from runs) where len(w) >= n)
        ),
        found as (select distinct p.doc_id, r.item, p.i, p.n from places p join runs r on p.run = r.run and p.n = r.n),
        hits as (
            select doc_id, count(distinct k) as n_hit
            from (select doc_id, unnest(range(i, i + n)) as k from found) group by doc_id
        ),
        named as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
            from (select distinct doc_id, item from found) group by doc_id
        )
        select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs d left join hits using (doc_id) left join named using (doc_id)
    """,
    "op3_license_scan": license_sql(),
    "op6_exact_dedup": f"""
        select doc_id,
               max(doc_id) over (partition by norm) as keep_id,
               count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept,
               sha256(norm) as text_sha256
        from (select doc_id, {_LOWER} as norm from documents)
    """,
    # Shares of n-grams are counted for all pairs of documents, the links then followed.
    "op7_ngram_join": rf"""
        with recursive words as (
            select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
        ),
        shingles as (
            select distinct doc_id, least(4, len(w)) as k, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') as s
            from (select *, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from words where len(w) > 0)
        ),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as common
            from shingles a join shingles b on a.s = b.s and a.k = b.k and a.doc_id < b.doc_id
            group by a.doc_id, b.doc_id
        ),
        links as (
            select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
            where 100 * common >= 85 * (x.n + y.n - common)
        ),
        ways as (select a, b from links union all select b, a from links),
        reached as (
            select a as doc_id, b as other from ways
            union select r.doc_id, w.b from reached r join ways w on w.a = r.other
        ),
        ends as (select doc_id, min(other) as other from reached group by doc_id)
        select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) as component_id
        from documents d left join sizes using (doc_id) left join ends using (doc_id)
    """,
    "op12_prefix_trie": trie_sql(),
}
