"""Personal data found by weak supervision.

Patterns propose spans.  Five labelers vote on each: the strict rule of its kind, its
shape, a gazetteer, the words before it, and its borders.  Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is; the
resulting probabilities train a naive Bayes span classifier on features of the span.
What it accepts is added to the spans of the strict rules, which always stay.

Only DataFrame operations touch the rows.  The driver sees counts of vote patterns and
of feature values, whose numbers are fixed by the lists below.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, text_or_empty

# The base kinds in their order, and what the strict rules look for.
BASE = ("email", "ip", "card", "phone")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
# Repeats of a group are possessive and without captures, which Java runs in a loop and not
# by recursion; what follows a repeat never needs its characters back, so the matches are
# those of plain repeats.  A run is tried from its start (or the last match) only, so that
# a long run costs its length and not its square.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)(?:password|passwd|token|secret|api[_-]?key)\x20?[=:]\x20?\x22?[A-Za-z0-9+/_-]{8,}",
    "name": rf"(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}\p{{Ll}}+",
}
# A text without this cannot hold the pattern.
NEEDS = {
    "email": "contains(text, '@')",
    "ip": "rlike(text, '[0-9][.][0-9]')",
    "card": "rlike(text, '[0-9][ -]?[0-9]')",
    "phone": "contains(text, '+')",
    "secret": "rlike(text, '[=:]')",
    "name": rf"rlike(text, r'[{''.join(sorted({t[-1] for t in TITLES}))}][.]? \p{{Lu}}')",
}
GAZETTEER = {
    "email": "mail|web|gmx|yahoo|outlook|example|[.](com|org|net|edu|de|fr|es)$",
    "ip": "^(10|127|172|192)[.]",
    "card": "^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": "^[+](1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": "password|token|key",
    "name": "mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|señor",
}
CUES = "mail|contact|phone|tel|call|fax|mobile|card|visa|account|ip|host|server|address|login|user|name|from|by|token|password"
LABELERS = ("rule", "shape", "gazetteer", "context", "border")
ROUNDS = 25


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Luhn sum over the digits from the right, every second one doubled."""
    each = (
        f"transform(split(reverse({digits}), ''), (d, i) -> case when i % 2 = 0 then int(d)"
        " when int(d) > 4 then 2 * int(d) - 9 else 2 * int(d) end)"
    )
    return f"aggregate({each}, 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0"


_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
RULES = {
    "email": "true",
    "ip": f"rlike(value, '^{_PART}([.]{_PART}){{3}}$')",
    "card": f"length({_digits('value')}) between 12 and 19 and {_luhn(_digits('value'))}",
    "phone": f"length({_digits('value')}) between 9 and 15",
}


def _by_kind(values: dict[str, str], other: str) -> str:
    cases = " ".join(f"when '{k}' then ({v})" for k, v in values.items())
    return f"case kind {cases} else ({other}) end"


def candidates(docs: DataFrame) -> DataFrame:
    """Every match of every pattern, with its place and its surroundings.

    ``row`` numbers the rows of ``docs``; a row without a match has one with null kind.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs["doc_id"].cast("long").alias("doc_id"),
        text_or_empty(docs).alias("text"),
    )
    found = numbered
    for kind, pattern in PATTERNS.items():
        needed = F.expr(NEEDS[kind])
        found = found.withColumn(
            f"{kind}_values",
            F.when(needed, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")),
        )
    for kind, pattern in PATTERNS.items():
        found = found.withColumn(
            f"{kind}_parts",
            F.when(F.size(f"{kind}_values") > 0, F.split("text", pattern, -1)),
        )
    of_kind = [
        f"""transform({kind}_values, (v, i) -> struct(
            '{kind}' as kind, i as i, v as value, char_length({kind}_parts[i]) as gap,
            right({kind}_parts[i], 24) as before, left({kind}_parts[i + 1], 8) as after))"""
        for kind in PATTERNS
    ]
    rows = found.select("row", "doc_id", F.explode_outer(F.expr(f"concat({', '.join(of_kind)})")).alias("m"))
    return rows.select("row", "doc_id", "m.*").withColumn("size", F.char_length("value"))


def _voted(spans: DataFrame) -> DataFrame:
    strict = spans.withColumn("strict", F.coalesce(F.expr(_by_kind(RULES, "false")), F.lit(False)))
    share = "length(regexp_replace(value, '[^0-9]', '')) / size"
    shapes = {
        "email": "size between 6 and 254",
        "ip": "size <= 15",
        "card": f"{share} > 0.7 and size between 12 and 23",
        "phone": f"{share} > 0.5 and size between 9 and 24",
        "secret": "size >= 16",
        "name": "size between 6 and 40",
    }
    gazetteer = _by_kind({k: f"rlike(lower(value), '{v}')" for k, v in GAZETTEER.items()}, "false")
    return (
        strict.withColumn("rule", F.expr("case when kind in ('secret', 'name') then 0 when strict then 1 else -1 end"))
        .withColumn("shape", F.expr(f"if({_by_kind(shapes, 'false')}, 1, -1)"))
        .withColumn("gazetteer", F.expr(f"if({gazetteer}, 1, 0)"))
        .withColumn("context", F.expr(f"if(rlike(lower(before), '({CUES})[^a-z]*$'), 1, 0)"))
        .withColumn(
            "border",
            F.expr("if(rlike(before, '[A-Za-z0-9_.]$') or rlike(after, '^[A-Za-z0-9_]'), -1, 1)"),
        )
    )


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS):
    """EM over vote patterns: ``(share of true spans, per labeler {vote: (P|true, P|false)})``.

    Starts from the mean vote; labelers are taken as independent given the truth.
    """
    total = sum(n for _, n in patterns)
    belief = [1 / (1 + math.exp(-sum(votes))) for votes, _ in patterns]
    prior, tables = 0.5, [{} for _ in LABELERS]
    for _ in range(rounds if total else 0):
        true = sum(n * p for (_, n), p in zip(patterns, belief))
        prior = (true + 1) / (total + 2)
        for k, table in enumerate(tables):
            for vote in (-1, 0, 1):
                own = [(n, p) for (votes, n), p in zip(patterns, belief) if votes[k] == vote]
                table[vote] = (
                    (sum(n * p for n, p in own) + 1) / (true + 3),
                    (sum(n * (1 - p) for n, p in own) + 1) / (total - true + 3),
                )
        belief = [_posterior(votes, prior, tables) for votes, _ in patterns]
    return prior, tables


def _posterior(votes: tuple[int, ...], prior: float, tables) -> float:
    odds = math.log(prior / (1 - prior)) + sum(
        math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes) if t
    )
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


_SIDE = "case when {0} = '' then 'none' when rlike({0}, '[A-Za-z]') then 'letter' when rlike({0}, '[0-9]') then 'digit' when {0} = ' ' then 'blank' else 'sign' end"
FEATURES = (
    "concat('kind ', kind)",
    "concat('size ', kind, ' ', least(8, size div 4))",
    "concat('digits ', kind, ' ', cast(floor(4 * length(regexp_replace(value, '[^0-9]', '')) / size) as int))",
    "concat('left ', " + _SIDE.format("right(before, 1)") + ")",
    "concat('right ', " + _SIDE.format("left(after, 1)") + ")",
)


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())]) if values else F.expr("map('', 0.0D)")


def personal_data(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """Spans of each row: ``row, doc_id, spans`` of ``(start, kind, end, base)``.

    Offsets are code points, ends exclusive.  Base spans follow the strict rules;
    added ones are those the classifier accepts and no base span overlaps.  Null
    texts are empty; rows are documents of their own, also with a null or repeated
    ``doc_id``; an empty table gives an empty one.
    """
    found = keep(candidates(docs), "pii-candidates")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("i"))
    placed = found.where("kind is not null").withColumn("end", upto).withColumn("start", F.col("end") - F.col("size"))
    voted = keep(_voted(placed).withColumn("features", F.array(*[F.expr(f) for f in FEATURES])), "pii-votes")

    counts = voted.groupBy(*LABELERS).agg(F.count("*").alias("n")).collect()
    prior, tables = reliabilities([(tuple(r[k] for k in LABELERS), r["n"]) for r in counts])
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, table in zip(LABELERS, tables):
        for vote, (true, false) in table.items():
            odds = odds + F.when(F.col(name) == vote, math.log(true / false)).otherwise(0.0)
    believed = voted.withColumn("belief", 1 / (1 + F.exp(-odds)))
    sums = believed.select("belief", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("belief").alias("true"), F.sum(1 - F.col("belief")).alias("false")
    ).collect()
    whole = believed.agg(F.sum("belief").alias("t"), F.sum(1 - F.col("belief")).alias("f")).first()
    t, f = (whole["t"] or 0.0) + 1, (whole["f"] or 0.0) + 1
    # Rounded, so that the order in which doubles are added cannot tip a span.
    weights = {
        r["feature"]: round(math.log((r["true"] + 1) / (t + 1) * (f + 1) / (r["false"] + 1)), 6) for r in sums
    }
    lookup = _literal_map(weights)
    score = F.aggregate(
        F.transform("features", lambda x: F.coalesce(F.element_at(lookup, x), F.lit(0.0))),
        F.lit(round(math.log(t / f), 6)),
        lambda a, x: a + x,
    )
    judged = voted.withColumn("accepted", score > math.log(accept / (1 - accept)))
    spans = judged.where("strict or accepted").groupBy("row").agg(
        F.array_sort(
            F.collect_list(F.struct(
                "start", F.expr(_by_kind({k: str(i) for i, k in enumerate(PATTERNS)}, "9")).alias("place"),
                "kind", "end", F.col("strict").alias("base"),
            ))
        ).alias("all")
    )
    free = spans.withColumn(
        "spans",
        F.expr("filter(all, s -> s.base or not exists(all, b -> b.base and b.start < s.end and s.start < b.end))"),
    )
    everyone = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"))
    return everyone.join(free.select("row", "spans"), "row", "left")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def pii_report(docs: DataFrame) -> DataFrame:
    found = personal_data(docs).withColumn("spans", F.expr("coalesce(spans, array())"))
    base = "filter(spans, s -> s.base)"
    return found.select(
        "doc_id",
        *[
            F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}")
            for k in BASE
        ],
        F.expr(f"sha2(cast({_joined(base)} as binary), 256)").alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
    )
