"""SQL that DuckDB runs on the same tables, for every registered query.

Each statement cleans ``events`` itself and then ranks, picks and joins with
window functions and subqueries, where the library uses aggregates.
"""

from __future__ import annotations

from postmeter.functions.columns import NULL_TOKENS
from postmeter.sources.events import EVENT_COLUMNS

SIX = ("platform", "sentiment", "location", "media_type", "influencer_brand", "post_type")

_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)
_DATE_FORM = (
    "^ *[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    "([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)? *$"
)
_NUMBER_FORM = "^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)? *$"

_RAW = "raw as (select " + ", ".join(f"{e} as {n}" for n, (_, e) in EVENT_COLUMNS.items()) + " from events)"


def _or_null(column: str) -> str:
    return f"case when {column} in ({_TOKENS}) then null else {column} end"


_MARKED = (
    "marked as (select "
    + ", ".join(f"{_or_null(n)} as {n}" for n in EVENT_COLUMNS if n != "event_id")
    + ", event_id from raw)"
)
_DATE = (
    f"case when regexp_matches(raw_date, '{_DATE_FORM}') then try_cast(trim(raw_date) as timestamp) end"
)
_ENGAGEMENTS = (
    f"coalesce(case when regexp_matches(raw_engagements, '{_NUMBER_FORM}')"
    " then try_cast(trim(raw_engagements) as double) end, 0.0)"
)
_PARSED = (
    f"parsed as (select {_DATE} as date, {_ENGAGEMENTS} as engagements, "
    + ", ".join(f"coalesce(raw_{c}, 'Unknown') as {c}" for c in SIX)
    + ", event_id from marked)"
)
_POSTS = "posts as (select * from parsed where date is not null)"


def _with(*ctes: str) -> str:
    return "with " + ", ".join([_RAW, _MARKED, _PARSED, _POSTS, *ctes]) + " "


_TOO_MANY = "'one too many'"
_UNDATED = "case when marked is null then 'no date' else 'not a date: ' || marked end as reason"


def _record(*more: str) -> str:
    """The text of a record as it is written, with more cells at its end."""
    cells = [f"coalesce({n}, '')" for n in EVENT_COLUMNS if n != "event_id"]
    quoted = [
        f"case when contains(raw_engagements, ',') then '\"' || raw_engagements || '\"' else {c} end" if "engagements" in c else c
        for c in cells
    ]
    return f"concat_ws(',', {', '.join([*quoted, *more])})"


def _cleaning() -> dict[str, str]:
    headers = [n.removeprefix("raw_") for n in EVENT_COLUMNS]
    posts_columns = ["date", "engagements", *SIX]
    return {
        "null_tokens": _with() + "select * from marked",
        "normalize_columns": _with()
        + "select "
        + ", ".join(f"{n} as {h}" for n, h in zip(EVENT_COLUMNS, headers))
        + " from raw",
        "parse_dates": _with() + "select event_id, date from parsed",
        "drop_invalid_dates": _with() + "select event_id, date from posts",
        "parse_engagements": _with() + "select event_id, engagements from parsed",
        "missing_engagements": _with()
        + "select event_id, date, cast(0 as double) as engagements from posts",
        "missing_categories": _with()
        + "select event_id, date, engagements, "
        + ", ".join(f"'Unknown' as {c}" for c in SIX)
        + " from posts",
        "fill_unknown": _with() + f"select event_id, {', '.join(SIX)} from parsed",
        "clean_posts": _with() + "select * from posts",
        "preview": _with() + "select * from posts order by date, event_id limit 5",
        "csv_source": _with()
        + f"select {', '.join(posts_columns)}, cast(event_id as varchar) as event_id from posts",
        "upload_stream": _with()
        + f"select {', '.join(posts_columns)}, cast(event_id as varchar) as event_id from posts",
        "csv_mixed_headers": _with()
        + f"select {', '.join(posts_columns)}, cast(event_id as varchar) as event_id from posts",
        "csv_by_folder": _with()
        + f"select {', '.join(posts_columns)}, cast(event_id as varchar) as event_id from posts",
        "parse_dates_formats": _with()
        + "select event_id, case when regexp_matches(raw_date, '^[0-9-]+$')"
        " then try_cast(raw_date || ' 02:30:00' as timestamp) end as date from raw",
        "clean_table": _with() + "select *, cast(date as date) as day from posts",
        # A short record keeps its first two cells.
        "csv_ragged": _with()
        + "select date, platform,"
        " case when event_id % 103 = 0 then 0.0 else engagements end as engagements, "
        + ", ".join(f"case when event_id % 103 = 0 then 'Unknown' else {c} end as {c}" for c in SIX if c != "platform")
        + ", case when event_id % 103 = 0 then null else cast(event_id as varchar) end as event_id"
        " from posts where event_id % 101 <> 0",
        "csv_rejects": _with()
        + f"select {_record('event_id', _TOO_MANY)} as record, 'more than 9 cells' as reason from raw where event_id % 101 = 0",
        "csv_multi_line": _with()
        + f"select {', '.join(posts_columns)}, cast(event_id as varchar) as event_id, case when event_id % 3 > 0"
        " then concat('said \"', event_id, '\",', chr(10), chr(10), 'then', chr(10), 'left') end as the_note from posts",
        "csv_left_out": _with()
        + f"select {_record('event_id', _TOO_MANY)} as record, 'more than 9 cells' as reason from raw where event_id % 101 = 0"
        f" union all select case when event_id % 103 = 0 then concat_ws(',', coalesce(raw_date, ''), coalesce(raw_platform, ''))"
        f" else {_record('event_id')} end, {_UNDATED} from (select r.*, p.date, m.raw_date as marked from raw r"
        " join parsed p using (event_id) join marked m using (event_id)) where date is null and event_id % 101 <> 0",
        "preview_files": _with()
        + f"select {', '.join(posts_columns)}, cast(event_id as varchar) as event_id from posts order by event_id::bigint desc limit 5",
        "undated_posts": _with()
        + "select '{\"date\":' || coalesce('\"' || marked || '\"', 'null') || ',\"platform\":' ||"
        " coalesce('\"' || raw_platform || '\"', 'null') || ',\"event_id\":' || event_id || '}' as record,"
        f" {_UNDATED} from (select p.event_id, p.date, m.raw_date as marked, m.raw_platform from parsed p"
        " join marked m using (event_id)) where date is null",
    }


# Text around the labels, by chart and rank.
_WORDS = {
    "sentiment": (
        ("dominant", "Most posts are ", None),
        ("second", "Next most common sentiment: ", "."),
        ("third", "In third place among sentiments: ", "."),
    ),
    "platform": (
        ("best", "Most engagement came from ", "."),
        ("second", "The runner-up platform by engagement is ", "."),
        ("third", "Further behind among platforms is ", "."),
    ),
    "media_type": (
        ("most_used", "The media type posted most often is ", "."),
        ("second", "The second largest share of media belongs to ", "."),
        ("third", "A smaller part of the media mix is ", "."),
    ),
    "location": (
        ("most_active", "The busiest location is ", "."),
        ("second", "The second busiest location is ", "."),
        ("third", "The top three locations are completed by ", "."),
    ),
}
_REQUEST = (
    "Write a short briefing on this campaign for its owner. State what the numbers above show, "
    "and close with three next steps, each tied to one of them."
)


def _metrics(brand: bool) -> dict[str, str]:
    b = "influencer_brand, " if brand else ""
    part = "partition by influencer_brand " if brand else ""
    group = "group by influencer_brand" if brand else ""

    def same(x: str, y: str) -> str:
        return f"{x}.influencer_brand = {y}.influencer_brand" if brand else "true"

    def counts(c: str) -> str:
        return f"select {b}{c}, count(*) as n from posts group by all"

    def top(c: str, k: int) -> str:
        return (
            _with(f"c as ({counts(c)})")
            + f"select {b}{c}, n, row_number() over ({part}order by n desc, {c}) as rank"
            f" from c qualify rank <= {k}"
        )

    def share(c: str) -> str:
        return (
            _with(f"c as ({counts(c)})")
            + f"select {b}{c}, n, n / sum(n) over ({part}) as share from c"
        )

    platform = f"select {b}platform, sum(engagements) as engagements from posts group by all"
    days = f"select {b}cast(date as date) as day, sum(engagements) as engagements from posts group by all"

    def chart(name: str) -> str:
        label = "strftime(date, '%Y-%m-%d')" if name == "day" else name
        return (
            f"select {b}'{name}' as chart, {label} as label, count(*) as n,"
            " sum(engagements) as engagements from posts group by all"
        )

    cube = " union all ".join(
        [chart(c) for c in ("sentiment", "platform", "media_type", "location", "day")]
        + [f"select {b}'total' as chart, null as label, count(*) as n, sum(engagements) as engagements from posts {group}"]
    )

    def edge(direction: str, tie: str, alias: str) -> str:
        return (
            f"select {b}engagements as {alias} from posts"
            f" qualify row_number() over ({part}order by date {direction}, {tie}) = 1"
        )

    def trended(first_tie: str, last_tie: str) -> list[str]:
        return [
            f"f as ({edge('asc', first_tie, 'first_engagements')})",
            f"l as ({edge('desc', last_tie, 'last_engagements')})",
            f"t as (select {b}count(*) as n_posts from posts {group})",
            f"trended as (select {'t.' if brand else ''}{b}n_posts, first_engagements, last_engagements,"
            " case when last_engagements > first_engagements then 'rising'"
            " when last_engagements < first_engagements then 'falling' else 'none' end as trend"
            f" from t join f on {same('t', 'f')} join l on {same('t', 'l')})",
        ]

    def post_trend(first_tie: str, last_tie: str) -> str:
        return _with(*trended(first_tie, last_tie)) + "select * from trended"

    ends = (
        f"select distinct {b}count(*) over ({part}) as n_days,"
        f" first_value(engagements) over ({part}order by day"
        " rows between unbounded preceding and unbounded following) as first_engagements,"
        f" last_value(engagements) over ({part}order by day"
        " rows between unbounded preceding and unbounded following) as last_engagements from d"
    )

    def best(table: str, order: str) -> str:
        return (
            _with(f"x as ({table})")
            + f"select * from x qualify row_number() over ({part}order by {order}) = 1"
        )

    def ranks(c: str, value: str) -> str:
        return (
            f"select *, sum(posts) over ({part}) as total,"
            f" row_number() over ({part}order by value desc, label) as position"
            f" from (select {b}{c} as label, cast({value} as double) as value, count(*) as posts"
            " from posts group by all)"
        )

    def rank_insights(c: str) -> str:
        value = "sum(engagements)" if c == "platform" else "count(*)"
        codes, texts = [], []
        for i, (code, before, after) in enumerate(_WORDS[c], start=1):
            codes.append(f"when {i} then '{code}'")
            if after is None:
                percent = (
                    "cast(cast((2000 * posts + total) // (2 * total) as bigint) // 10 as varchar) || '.' ||"
                    " cast(cast((2000 * posts + total) // (2 * total) as bigint) % 10 as varchar)"
                )
                texts.append(
                    f"when {i} then '{before}' || label || ', which makes up ' || {percent}"
                    " || '% of the total.'"
                )
            else:
                texts.append(f"when {i} then '{before}' || label || '{after}'")
        share_of = "value / total" if c in ("sentiment", "media_type") else "cast(null as double)"
        return (
            f"select {b}'{c}' as chart, position, case position {' '.join(codes)} end as code, label,"
            f" value, {share_of} as share, case position {' '.join(texts)} end as text"
            f" from ({ranks(c, value)}) where position <= 3"
        )

    def day_insight(position: int, code: str, words: str, order: str) -> str:
        return (
            f"select {b}'engagement' as chart, {position} as position, '{code}' as code,"
            " strftime(day, '%Y-%m-%d') as label, engagements as value, cast(null as double) as share,"
            f" '{words}' || strftime(day, '%Y-%m-%d') || ' with ' || cast(cast(trunc(engagements) as bigint) as varchar)"
            " || '.' as text"
            f" from d qualify row_number() over ({part}order by {order}) = 1"
            f" and count(*) over ({part}) >= 2"
        )

    day_insights = (
        f"select {b}'engagement' as chart, 1 as position,"
        " case when n_days < 2 then 'not_enough_data' else 'trend' end as code,"
        " case when n_days < 2 then null when last_engagements > first_engagements then 'rising'"
        " when last_engagements < first_engagements then 'falling' else 'stable' end as label,"
        " case when n_days >= 2 then last_engagements - first_engagements end as value,"
        " cast(null as double) as share,"
        " case when n_days < 2 then 'There are too few days to see a trend.'"
        " when last_engagements > first_engagements then 'Engagement rises from the first day to the last.'"
        " when last_engagements < first_engagements then 'Engagement falls from the first day to the last.'"
        " else 'Engagement ends at the level of the first day.' end as text from e"
        " union all " + day_insight(2, "peak_day", "Engagement was highest on ", "engagements desc, day")
        + " union all " + day_insight(3, "lowest_day", "Engagement was lowest on ", "engagements, day")
    )
    d_and_e = (f"d as ({days})", f"e as ({ends})")
    insights = {
        c: rank_insights(c) for c in ("sentiment", "platform", "media_type", "location")
    }

    def leading(c: str) -> str:
        value = "sum(engagements)" if c == "platform" else "count(*)"
        return f"lead_{c} as (select {b}label from ({ranks(c, value)}) where position = 1)"

    leads = [leading(c) for c in ("sentiment", "platform", "media_type", "location")]
    joined = (
        " join lead_platform p on " + same("s", "p")
        + " join lead_media_type m on " + same("s", "m")
        + " join lead_location o on " + same("s", "o")
    )
    findings = (
        "'leading sentiment: ' || s.label || '; platform with most engagement: ' || p.label"
        " || '; most frequent media type: ' || m.label || '; busiest location: ' || o.label"
    )
    s_brand = "s.influencer_brand, " if brand else ""
    one_line = [
        (1, "dominant_sentiment", "'Dominant sentiment: ' || s.label || '.'"),
        (
            2,
            "engagement_trend",
            "case when n_days >= 2 then case when last_engagements > first_engagements"
            " then 'Engagement is rising overall.' else 'The last day brought no more engagement than the first.' end end",
        ),
        (3, "best_platform", "'Best performing platform: ' || p.label || '.'"),
        (4, "main_media_type", "'Main media type: ' || m.label || '.'"),
        (5, "top_location", "'Most active location: ' || o.label || '.'"),
    ]
    from_leads = f" from lead_sentiment s{joined} join e on {same('s', 'e')}"

    def lines(field: str, rows: list[tuple[int, str, str]]) -> str:
        return (
            _with(*d_and_e, *leads)
            + "select * from ("
            + " union all ".join(
                f"select {s_brand}{i} as position, '{name}' as {field}, {text} as text{from_leads}"
                for i, name, text in rows
            )
            + ") where text is not null"
        )

    def document(analysis: str | None, text: str | None = None, holds: str = "true") -> str:
        rows = [(1, "title", "'Campaign report: ' || s.influencer_brand" if brand else "'Campaign report'")]
        if analysis is not None:
            text = text or f"'{analysis}'"
            rows += [
                (2, "analysis_heading", f"case when {holds} then 'Analysis and recommendations' end"),
                (3, "analysis", f"case when {holds} then {text} end"),
            ]
        rows.append((4, "findings_heading", "'Main findings'"))
        rows += [(i + 4, "finding", text) for i, _, text in one_line]
        rows.append((10, "footer", "'End of report'"))
        return lines("section", rows)

    def listed(c: str, limit: str = "") -> list[str]:
        value = "sum(engagements)" if c == "platform" else "count(*)"
        whole = "cast(cast(value as bigint) as varchar)"
        return [
            f"list_{c} as (select {b}'{{' || string_agg('\"' || label || '\":' || {whole}, ','"
            f" order by value desc, label) || '}}' as js,"
            f" string_agg(label || ' ' || {whole}, ', ' order by value desc, label) as words"
            f" from ({ranks(c, value)}) {limit} {group})"
        ]

    lists = [
        *listed("sentiment"),
        *listed("platform"),
        *listed("media_type"),
        *listed("location", "where position <= 3"),
    ]

    def summary_of(first_tie: str, last_tie: str) -> list[str]:
        text = (
            "'Posts: ' || t.n_posts || chr(10) || 'Posts per sentiment: ' || ls.words || chr(10)"
            " || 'Engagement per platform: ' || lp.words || chr(10) || 'Posts per media type: ' || lm.words"
            " || chr(10) || 'Top locations: ' || lo.words || chr(10) || 'Trend: ' || case t.trend"
            " when 'rising' then 'engagement rises over the campaign'"
            " when 'falling' then 'engagement falls over the campaign'"
            " else 'first and last post are level' end"
        )
        t_brand = "t.influencer_brand, " if brand else ""
        return [
            *trended(first_tie, last_tie),
            *lists,
            f"summed as (select {t_brand}t.n_posts as total_posts, ls.js as sentiment_counts,"
            " lp.js as platform_engagements, lm.js as media_type_counts, lo.js as top_locations,"
            f" t.trend, {text} as summary from trended t"
            f" join list_sentiment ls on {same('t', 'ls')} join list_platform lp on {same('t', 'lp')}"
            f" join list_media_type lm on {same('t', 'lm')} join list_location lo on {same('t', 'lo')})",
        ]

    return {
        "total_posts": _with() + f"select {b}count(*) as n from posts {group}",
        "sentiment_counts": _with() + counts("sentiment"),
        "media_type_counts": _with() + counts("media_type"),
        "location_counts": _with() + counts("location"),
        "platform_engagement": _with() + platform,
        "platform_ranking": _with() + platform,
        "daily_engagement": _with() + days,
        "sentiment_share": share("sentiment"),
        "media_type_share": share("media_type"),
        "campaign_cube": _with() + cube,
        "campaign_cube_one_scan": _with() + cube,
        "campaign_cube_scan_per_chart": _with() + cube,
        "cleaning_outcome": _with()
        + f"select {'m.' if brand else ''}{b}count(*) as rows_in, count(*) filter (where date is null) as rows_without_date,"
        " count(date) as rows_kept,"
        f" count(*) filter (where date is not null and raw_engagements is not null and not"
        f" (regexp_matches(raw_engagements, '{_NUMBER_FORM}') and isfinite(try_cast(trim(raw_engagements) as double)))) as bad_engagements,"
        " count(*) filter (where date is not null and raw_engagements is null) as null_engagements,"
        f" false as engagements_absent from (select p.*, m.raw_engagements from parsed p join marked m using (event_id)) m {group}",
        "top5_locations": top("location", 5),
        "top3_locations": top("location", 3),
        "sentiment_top3": top("sentiment", 3),
        "media_type_top3": top("media_type", 3),
        "platform_top3": _with(f"c as ({platform})")
        + f"select {b}platform, engagements,"
        f" row_number() over ({part}order by engagements desc, platform) as rank from c qualify rank <= 3",
        "post_trend": post_trend("engagements", "engagements"),
        "post_trend_ordered": post_trend("event_id", "event_id desc"),
        "daily_trend": _with(*d_and_e)
        + f"select {b}n_days, first_engagements, last_engagements,"
        " case when n_days < 2 then 'not_enough_data' when last_engagements > first_engagements then 'rising'"
        " when last_engagements < first_engagements then 'falling' else 'stable' end as trend,"
        " case when n_days >= 2 then last_engagements > first_engagements end as is_rising from e",
        "peak_day": best(days, "engagements desc, day"),
        "lowest_day": best(days, "engagements, day"),
        "top_platform": best(platform, "engagements desc, platform"),
        "dominant_labels": _with()
        + " union all ".join(
            f"select {b}'{c}' as category, {c} as label, n from ({counts(c)})"
            f" qualify row_number() over ({part}order by n desc, {c}) = 1"
            for c in ("sentiment", "media_type", "location")
        ),
        **{f"{c}_insights": _with() + sql for c, sql in insights.items()},
        "engagement_insights": _with(*d_and_e) + day_insights,
        "campaign_insights": _with(*d_and_e)
        + " union all ".join([*insights.values(), day_insights]),
        "report_lines": lines("code", one_line),
        "report_document": document("Post more in the evening."),
        "report_table": document(None),
        "report_with_analyses": document("", "'On ' || s.influencer_brand", "s.influencer_brand < 'Brand15'"),
        "campaign_summary_fractions": (
            _with(*summary_of("engagements", "engagements"))
            .replace("posts as (select * from", "posts as (select * replace (engagements * 64 + 0.5 as engagements) from", 1)
            .replace("cast(cast(value as bigint) as varchar)", "regexp_replace(cast(value as varchar), '[.]0$', '')")
            + f"select {b}total_posts, trend, summary from summed"
        ),
        "summary_chunks": _with()
        + " union all ".join(
            f"select {b}'{c}' as chart, (position - 1) // 5 as chunk, count(*) as n_labels,"
            " string_agg(label || ' ' || cast(cast(value as bigint) as varchar), ', ' order by position) as text"
            f" from ({ranks(c, 'sum(engagements)' if c == 'platform' else 'count(*)')}) group by all"
            for c in ("sentiment", "platform", "media_type", "location")
        ),
        "campaign_summary": _with(*summary_of("event_id", "event_id desc")) + "select * from summed",
        "prompt_findings": _with(*leads)
        + f"select {s_brand}{findings} as findings from lead_sentiment s{joined}",
        "campaign_prompts": _with(*summary_of("engagements", "engagements"), *leads)
        + f"select {s_brand}q.summary, {findings} as findings,"
        " 'Summary of the campaign data:' || chr(10) || q.summary || chr(10) || chr(10)"
        f" || 'Main findings: ' || {findings} || chr(10) || chr(10) || '{_REQUEST}' as prompt"
        f" from lead_sentiment s{joined} join summed q on {same('s', 'q')}",
    }


def statements() -> dict[str, str]:
    whole, brands = _metrics(brand=False), _metrics(brand=True)
    report_table, analyses = brands.pop("report_table"), brands.pop("report_with_analyses")
    whole.pop("report_table"), whole.pop("report_with_analyses")
    whole["cleaning_outcome_observed"] = whole["cleaning_outcome"]
    for table in (whole, brands):
        table["merged_cube"], table["merged_prompts"] = table["campaign_cube"], table["campaign_prompts"]
    return {
        **_cleaning(),
        "report_table": report_table,
        "report_folders": report_table,
        "report_with_analyses_by_brand": analyses,
        **whole,
        **{f"{name}_by_brand": sql for name, sql in brands.items()},
    }
