"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans. Labellers (shape, gazetteer, context, borders, digits)
vote on each or abstain. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeller is; the posteriors then train a
logistic classifier of spans, which decides on everything but the base spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

# The base kinds in their order, then the kinds the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("ssn", "secret", "name")
KINDS = BASE_KINDS + MORE_KINDS

# Each finds the same leftmost matches as its plain form, in linear time and
# without recursion: quantifiers are possessive where giving back cannot help,
# and a match starts where its run of characters starts or the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NATIONAL = r"(?<![0-9+(])\([0-9]{3}\)[\x20-][0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9+.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# Of any length; dots and equals signs inside or equals signs at the end belong to it.
SECRET = (
    r"\b(?i:token|secret|api[_-]?key|password)\x20?[=:]\x20?\x22?(?=[A-Za-z0-9_+/.=-]{16})"
    r"[A-Za-z0-9_+/-]++(?:[.=]++[A-Za-z0-9_+/-]++)*+=*+"
)
# All capitalised words after a title.
NAME = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?(?:\x20\p{Lu}[\p{L}\p{M}\x27’-]++)++"
MORE = f"{NATIONAL}|{SSN}|{SECRET}|{NAME}"

CUES = r"(?i)(?:call|tel|phone|fax|mobile|mail|contact|reach|card|visa|account|host|address|server|login|ssn|credential)[^\n]{0,12}$"
AGAINST = r"(?i)(?:version|release|isbn|issue|page|section|chapter|order|figure|table)[^\n]{0,6}$"
VOTES = ("shape", "gazetteer", "context", "border", "digits")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """What a base match must also satisfy."""
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: Column, value: Column) -> Column:
    """1 or 0 where a list knows the value's head or tail."""
    end = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us)$"
    codes = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}\)?[\x20-]"
    return (
        F.when(kind == "email", value.rlike(end))
        .when(kind == "phone", value.rlike(codes))
        .when(kind == "card", value.rlike("^[3-6]"))
        .when(kind == "ip", ~value.rlike(r"^(?:0|10|127|192\.168|2[3-9][0-9])\."))
        .when(kind == "ssn", ~value.rlike("^(?:000|666|9)"))
        .when(kind == "secret", value.rlike("[0-9]") & value.rlike("[A-Za-z]"))
        .otherwise(F.lit(True))
        .cast("int")
    )


def _spans(text: Column, pattern: str, maybe: Column, kind, base: Column | None) -> Column:
    """Array of candidates of one pattern, with places in code points.

    The pieces between matches and the matches themselves alternate, so a
    running sum of their lengths gives the places.
    """
    matches = F.when(maybe, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    pieces = F.when(maybe, F.split(text, pattern, -1))
    steps = F.arrays_zip(
        matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("a"), F.slice(pieces, 2, F.size(matches)).alias("b")
    )

    def step(state: Column, x: Column) -> Column:
        m = x["m"]
        start = state["at"] + F.length(x["a"])
        left, right = F.substring(x["a"], -24, 24), F.substring(x["b"], 1, 1)
        name = kind(m)
        valid = base(m) if base is not None else F.lit(None).cast("boolean")
        edge = (left == "") | left.rlike(r"[\s\x22'(\[<:=,;]$")
        after = (right == "") | right.rlike(r"[\s\x22')\]>.,;:!?%$&*#|]")
        item = F.struct(
            start.cast("bigint").alias("start"),
            (start + F.length(m)).cast("bigint").alias("end"),
            name.alias("kind"),
            F.coalesce(valid, F.lit(False)).alias("base"),
            F.least(F.floor(F.length(m) / 8), F.lit(4)).cast("int").alias("long"),
            valid.cast("int").alias("shape"),
            _gazetteer(name, m).alias("gazetteer"),
            F.when(left.rlike(CUES), 1).when(left.rlike(AGAINST), 0).alias("context"),
            (edge & after).cast("int").alias("border"),
            F.when(name.isin("email", "name"), F.lit(None).cast("int"))
            .otherwise((F.size(F.array_distinct(F.split(_digits(m), ""))) >= 4).cast("int"))
            .alias("digits"),
        )
        return F.struct((start + F.length(m)).cast("bigint").alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    votes = ",".join(f"{v}:int" for v in VOTES)
    empty = f"array<struct<start:bigint,end:bigint,kind:string,base:boolean,long:int,{votes}>>"
    start = F.expr(f"named_struct('at', 0L, 'out', cast(array() as {empty}))")
    found = F.aggregate(steps, start, step)["out"]
    # Most texts have no match; the fold runs only where one was found.
    return F.when(F.size(matches) > 0, found).otherwise(F.expr(f"cast(array() as {empty})"))


def candidates(text: Column) -> Column:
    """All spans that any pattern proposes in a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    digit = text.rlike("[0-9]")
    maybe = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    more = _spans(
        text, MORE, text.rlike(MORE),
        lambda m: F.when(m.rlike(f"^(?:{NATIONAL})$"), "phone").when(m.rlike(f"^(?:{SSN})$"), "ssn")
        .when(m.rlike("[=:]"), "secret").otherwise("name"),
        None,
    )
    return F.concat(
        *[_spans(text, PATTERNS[k], maybe[k], lambda m, k=k: F.lit(k), lambda m, k=k: _valid(k, m)) for k in BASE_KINDS], more
    )


@dataclass
class SpanModel:
    """Weights of the final classifier: by feature name, and the labellers' reliabilities."""

    weights: dict[str, float]
    reliability: dict[str, float]

    def score(self, span: Column) -> Column:
        total = F.lit(self.weights.get("bias", 0.0))
        for name, weight in self.weights.items():
            field, _, value = name.partition("=")
            if value:
                total = total + F.when(span[field] == F.lit(value if field == "kind" else int(value)), F.lit(weight)).otherwise(0.0)
        return total


def _em(table: list[dict], rounds: int = 60) -> tuple[dict[str, float], list[float]]:
    """Reliabilities of the labellers and the posterior of each vote pattern.

    table: rows of kind, votes and n. A labeller is right with one
    probability, whatever the truth; each kind has its own share of true
    spans. Starts from labellers that are mostly right.
    """
    right = {v: 0.8 for v in VOTES}
    share = {k: 0.5 for k in KINDS}
    posterior = [0.5] * len(table)
    for _ in range(rounds):
        for i, row in enumerate(table):
            odds = math.log(share[row["kind"]] / (1 - share[row["kind"]]))
            for v in VOTES:
                if row[v] is not None:
                    odds += (1 if row[v] else -1) * math.log(right[v] / (1 - right[v]))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for v in VOTES:
            # Two imagined votes of four in five right keep a silent labeller at its start.
            hit, all_ = 8.0, 10.0
            for p, row in zip(posterior, table):
                if row[v] is not None:
                    hit += row["n"] * (p if row[v] else 1 - p)
                    all_ += row["n"]
            right[v] = min(0.99, max(0.51, hit / all_))
        for k in KINDS:
            own = [(p, row["n"]) for p, row in zip(posterior, table) if row["kind"] == k]
            total = sum(n for _, n in own)
            share[k] = min(0.98, max(0.02, (sum(p * n for p, n in own) + 1) / (total + 2)))
    return right, posterior


def _features(row: dict) -> list[str]:
    return ["bias", f"kind={row['kind']}", f"long={row['long']}"] + [f"{v}={row[v]}" for v in VOTES if row[v] is not None]


def fit(spans: DataFrame, rounds: int = 200) -> SpanModel:
    """Trains on all proposed spans (columns of the candidate struct).

    Only the counts of distinct patterns of kind, length class and votes reach
    the driver: at most 7 * 5 * 3^5 rows, whatever the corpus.
    """
    counted = spans.groupBy("kind", "long", *VOTES).agg(F.count(F.lit(1)).alias("n"))
    table = sorted((r.asDict() for r in counted.collect()), key=lambda r: str(sorted(r.items())))
    reliability, posterior = _em(table)
    total = sum(r["n"] for r in table) or 1
    named = [_features(r) for r in table]
    weights = {f: 0.0 for f in sorted({f for fs in named for f in fs})}
    for _ in range(rounds):
        gradient = {f: -0.001 * w for f, w in weights.items()}
        for row, fs, p in zip(table, named, posterior):
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in fs)))))
            # Patterns count by the root of their frequency, so rare kinds are learned too.
            pull = math.sqrt(row["n"] / total) * (p - guess)
            for f in fs:
                gradient[f] += pull
        for f, g in gradient.items():
            weights[f] += 0.5 * g
    return SpanModel({f: round(w, 6) for f, w in weights.items()}, reliability)


def decide(found: Column, model: SpanModel) -> Column:
    """Base spans, and other candidates the model takes that touch no base span; by place and kind."""
    order = F.array(*[F.lit(k) for k in KINDS])
    base = F.filter(found, lambda c: c["base"])
    more = F.filter(
        found,
        lambda c: ~c["base"]
        & (model.score(c) > 0)
        & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    plain = lambda c: F.struct(
        c["start"].alias("start"), F.array_position(order, c["kind"]).alias("rank"), c["end"].alias("end"),
        c["kind"].alias("kind"), c["base"].alias("base"),
    )
    return F.array_sort(F.transform(F.concat(base, more), plain))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")


def _pieces(text: Column, spans: Column) -> Column:
    """Struct of ``at``, where the last span ends, and ``out``, the text up to
    there with every span replaced by its kind in angle brackets.

    Spans come by start; one that overlaps what is already replaced only
    extends the replaced stretch.
    """

    def step(state: Column, c: Column) -> Column:
        piece = F.when(
            c["start"] >= state["at"],
            F.concat(F.substring(text, state["at"] + 1, c["start"] - state["at"]), F.lit("<"), F.upper(c["kind"]), F.lit(">")),
        ).otherwise("")
        return F.struct(
            F.greatest(state["at"], c["end"]).cast("int").alias("at"), F.concat(state["out"], F.array(piece)).alias("out")
        )

    short = F.transform(spans, lambda c: F.struct(c["start"].cast("int").alias("start"), c["end"].cast("int").alias("end"), c["kind"].alias("kind")))
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<string>))")
    return F.aggregate(short, start, step)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data of every document.

    docs: doc_id, text; other columns are ignored. Returns one row per input
    row: doc_id, spans (array of start, rank, end, kind, base). A null text
    counts as empty and has no spans. Equal texts get equal spans. The
    proposed spans, without the texts, are written to the shared folder once.
    """
    found = cut_lineage(docs.select("doc_id", candidates(F.col("text")).alias("found")), "candidates")
    model = fit(found.select(F.inline("found")))
    return found.select("doc_id", decide(F.col("found"), model).alias("spans"))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind; all columns stay.

    ``n_chars`` follows the new text where the column is there. Null and empty
    texts stay as they are, repeated rows are masked alike, columns keep their
    names, whatever they are called, and an empty table stays empty. Rows and
    their proposed spans are written once, so the patterns run once per text,
    however long it is.
    """
    # The row travels as one value, so that its names meet no others.
    rows = cut_lineage(docs.select(F.struct(*docs.columns).alias("row"), candidates(F.col("text")).alias("found")), "candidates")
    model = fit(rows.select(F.inline("found")))
    text = F.col("row")["text"]
    # One column a step, so that each is computed once.
    steps = rows.select("row", decide(F.col("found"), model).alias("spans"))
    steps = steps.select("row", F.when(F.size("spans") > 0, _pieces(text, F.col("spans"))).alias("done"))
    rest = F.substring(text, F.col("done")["at"] + 1, F.length(text))
    hidden = F.when(F.col("done").isNotNull(), F.concat(F.array_join(F.col("done")["out"], ""), rest)).otherwise(text)
    steps = steps.select("row", hidden.alias("hidden"))
    kinds = dict(docs.dtypes)
    changed = {"text": F.col("hidden"), "n_chars": F.length("hidden").cast(kinds.get("n_chars", "bigint"))}
    return steps.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
