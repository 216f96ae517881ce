"""Personal data by candidate boosting.

Generators with high recall propose spans that may overlap: the four base patterns, and looser forms of e-mail addresses and numbers.
Base spans that pass their checks are personal data. They, and what they are in the looser forms, teach gradient-boosted trees, on features
of format and context, what personal data looks like; the trees then judge the other candidates, and a threshold for each kind, calibrated on
candidates they have not seen, selects those that are added.

Everything is SQL functions and Spark's own trees. Positions come from the text between matches: a match starts where the matches and
gaps before it end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.llm.text import ROW_KEY, bound, identified
from runsight.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
TREES, DEPTH = 10, 3

_LOCAL = r"[A-Za-z0-9._%+-]"
GENERATORS = {
    # The base patterns. Each may only start where a run of its first characters starts or a match has just ended, which is where the
    # leftmost match is, and takes its runs whole; so long texts without a match cost linear time, and no recursion.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Of the runs of digits with single separators, those long enough for a card.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Looser forms.
    "spelled email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    # What stands inside base matches that took in their neighbours too, and so failed their checks.
    "formed phone": r"\+[0-9]{1,3}+(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,3}(?![0-9])",
    "formed card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{2,4}(?![0-9A-Za-z])",
    "number": r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){8,18}+(?![0-9A-Za-z])",
}
_NEEDED = {"email": "@", "phone": "+", "formed phone": "+"}
LEAST_THRESHOLD = 0.5
"""No threshold is lower, however clean the examples above it are."""
_CUES = r"(?i)\b(?:tel|phone|call|fax|mobile|mail|contact|card|visa|ip|host|address|server)\b"
FEATURES = ["chars", "digits", "groups", "dots", "spaces", "dashes", "brackets", "plus", "at", "stops", "distinct_digits", "luhn", "octets", "cue", "letter_before", "letter_after"]


def _matches(text: Column, name: str) -> Column:
    """(generator, place, gap before, match, text around) of each match, in order."""
    pattern = GENERATORS[name]
    found = F.regexp_extract_all(text, F.lit(pattern), 0)

    def each(gaps: Column) -> Column:
        return F.transform(
            found,
            lambda m, i: F.struct(
                F.lit(name).alias("generator"),
                i.alias("place"),
                F.length(F.get(gaps, i)).cast("long").alias("gap"),
                m.alias("match"),
                F.right(F.get(gaps, i), F.lit(24)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"),
            ),
        )

    needed = text.contains(_NEEDED[name]) if name in _NEEDED else text.rlike("[(\\[]at[)\\]]") if name == "spelled email" else text.rlike("[0-9]")
    return F.when(needed, bound(F.split(text, pattern, -1), each)).otherwise(F.array().cast(_MATCH))


_MATCH = "array<struct<generator:string,place:int,gap:bigint,match:string,before:string,after:string>>"


def _valid() -> Column:
    """Whether a base pattern's match passes its check."""
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    octets = F.forall(F.split("match", r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        F.split("match", r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255
    )
    card = digits.between(14, 19) & F.call_function("luhn_check", F.regexp_replace("match", "[^0-9]", ""))
    kind = F.col("generator")
    return F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", digits.between(10, 15)).otherwise(False)


def candidates(docs: DataFrame) -> DataFrame:
    """Each proposed span of each distinct document: ROW_KEY, generator, kind, start, end, base, match, before, after.

    Start and end count code points, the end exclusive. `base` marks matches of a base pattern that pass its check.
    """
    text = F.coalesce("text", F.lit(""))
    # The outer form, since for the other the optimizer would search each text once more, to test whether there are matches.
    found = identified(docs).select(*ROW_KEY, F.explode_outer(F.concat(*[_matches(text, name) for name in GENERATORS])).alias("_m"))
    found = found.filter("_m IS NOT NULL").select(*ROW_KEY, "_m.*").distinct()
    order = Window.partitionBy(*ROW_KEY, "generator").orderBy("place")
    width = F.length("match").cast("long")
    end = F.sum(F.col("gap") + width).over(order)
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    kind = (
        F.when(F.col("generator") == "spelled email", "email")
        .when(F.col("generator") == "formed phone", "phone")
        .when(F.col("generator") == "formed card", "card")
        .when(F.col("generator") == "number", F.when(digits >= 14, "card").otherwise("phone"))
        .otherwise(F.col("generator"))
    )
    return found.withColumn("end", end).select(*ROW_KEY, "generator", kind.alias("kind"), (F.col("end") - width).alias("start"), "end", _valid().alias("base"), "match", "before", "after")


def with_features(found: DataFrame) -> DataFrame:
    """Format and context of each candidate, as numbers."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    count = lambda signs: F.length("match") - F.length(F.regexp_replace("match", signs, ""))
    octet = F.col("match").rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    values = {
        "chars": F.length("match"),
        "digits": F.length(digits),
        "groups": F.size(F.split("match", "[^0-9A-Za-z]+")),
        "dots": count(r"\."),
        "spaces": count(" "),
        "dashes": count("-"),
        "brackets": count(r"[()\[\]]"),
        "plus": F.col("match").startswith("+"),
        "at": F.col("match").contains("@") | F.col("match").rlike(r"[(\[]at[)\]]"),
        "stops": F.col("match").contains(". "),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, ""))),
        "luhn": F.coalesce(F.call_function("luhn_check", digits), F.lit(False)),
        "octets": octet,
        "cue": F.coalesce(F.col("before"), F.lit("")).rlike(_CUES),
        "letter_before": F.coalesce(F.col("before"), F.lit("")).rlike(r"\p{L}$"),
        "letter_after": F.coalesce(F.col("after"), F.lit("")).rlike(r"^\p{L}"),
    }
    return found.withColumns({name: value.cast("double") for name, value in values.items()})


@dataclass
class Selector:
    trees: GBTClassificationModel
    thresholds: dict[str, float]
    """By kind; of a kind without one, nothing is selected."""

    def scored(self, found: DataFrame) -> DataFrame:
        """With `probability` that a candidate is personal data."""
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep").transform(with_features(found))
        judged = self.trees.transform(vectors)
        return judged.withColumn("probability", vector_to_array("_probability")[1]).drop("_features", "_probability", "_raw", "_said", *FEATURES)

    def selected(self, found: DataFrame) -> DataFrame:
        """Those scored above the threshold of their kind. A card number must have 14 to 19 digits and its check digit, a phone number 10 to 15."""
        least = F.create_map(*[F.lit(x) for item in {**dict.fromkeys(KINDS, 1.01), **self.thresholds}.items() for x in item])
        digits = F.regexp_replace("match", "[^0-9]", "")
        sound = F.when(F.col("kind") == "card", F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)).when(F.col("kind") == "phone", F.length(digits).between(10, 15)).otherwise(True)
        return self.scored(found.filter(sound)).filter(F.col("probability") > least[F.col("kind")])


def _marked_free(spans: DataFrame) -> DataFrame:
    """With `_free`: whether a span overlaps no base span of its document."""
    order = Window.partitionBy(*ROW_KEY).orderBy("start")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return spans.withColumn("_free", (F.coalesce(before, F.lit(0)) <= F.col("start")) & F.coalesce(after >= F.col("end"), F.lit(True)))


def _form(match: Column) -> Column:
    return F.regexp_replace(match, "[0-9]", "9")


def _rewritten(base: DataFrame) -> DataFrame:
    """Base spans in the looser forms (label 1); and e-mail addresses as the end of one sentence and the start of another (label 0)."""
    match, kind = F.col("match"), F.col("kind")
    spelled = lambda at, dot: F.concat(F.substring_index(match, "@", 1), F.lit(at), F.replace(F.substring_index(match, "@", -1), F.lit("."), F.lit(dot)))
    as_form = lambda text, label: F.struct(text.alias("match"), F.lit(label).alias("label"))
    email = [as_form(spelled(at, dot), 1.0) for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."))]
    email.append(as_form(spelled(" (at) ", ". "), 0.0))
    phone = [as_form(F.substring(match, 2, 40), 1.0), as_form(F.regexp_replace(match, r"^\+[0-9]{1,3}[ .-]+", ""), 1.0)]
    card = [as_form(F.regexp_replace(match, "[ -]", "."), 1.0)]
    forms = F.when(kind == "email", F.array(*email)).when(kind == "phone", F.array(*phone)).when(kind == "card", F.array(*card))
    out = base.select("kind", "before", "after", "_hash", match.alias("_was"), F.explode(forms).alias("_f")).select("*", "_f.*").filter("match <> _was").drop("_f", "_was")
    # Only what the looser generators would propose, and as that kind.
    number = F.col("match").rlike(f"^(?:{GENERATORS['number']})$") & ((F.length(F.regexp_replace("match", "[^0-9]", "")) >= 14) == (F.col("kind") == "card"))
    return out.filter(F.when(kind == "email", F.col("match").rlike(f"^(?:{GENERATORS['spelled email']})$")).otherwise(number))


def fit(found: DataFrame) -> Selector | None:
    """Trees that tell base spans, also in the looser forms, from the generators' other candidates, fitted to all of these.

    Examples with equal features are one row with a weight, so the trees' passes grow with what differs, not with the documents.
    Half of them teach, the other half sets the threshold of each kind: the least at which `PRECISION` of the selected ones are base spans,
    as they are or rewritten. None if there aren't candidates of both sorts.
    """
    # A loose match that overlaps a base span is never added and says nothing about loose forms.
    told = _marked_free(found).filter("base OR _free")
    chosen = told.groupBy("kind", "match", "before", "after").agg(F.max("base").alias("base"), F.max(F.col("generator") == "spelled email").alias("_spelled"))
    chosen = chosen.withColumn("_hash", F.xxhash64("match", "before", "after"))
    chosen = stage(chosen, "pii_chosen")
    loose = _rewritten(chosen.filter("base"))
    # Whether a candidate in a form that a base span can have is personal data isn't known: no example of the contrary. Bare digits are
    # told from such numbers by nothing but context, so they stay.
    own = chosen.filter("base AND kind IN ('card', 'phone')").select("kind", "match")
    forms = loose.filter("label = 1 AND kind <> 'email'").select("kind", "match").unionByName(own)
    forms = forms.select("kind", _form(F.col("match")).alias("_form")).filter("_form RLIKE '[^9]'").distinct()
    others = chosen.filter("NOT base AND NOT _spelled").withColumn("_form", _form(F.col("match"))).join(forms, ["kind", "_form"], "left_anti")
    columns = ["kind", "match", "before", "after", "_hash", "label"]
    taught = chosen.filter("base").withColumn("label", F.lit(1.0)).select(columns).unionByName(others.withColumn("label", F.lit(0.0)).select(columns)).unionByName(loose.select(columns))
    taught = with_features(taught).groupBy(*FEATURES, "kind", "label", (F.col("_hash") % 2 == 0).alias("_teach")).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    # In one order, so that what Spark's trees draw to place their splits is the same in each run.
    taught = stage(taught.repartitionByRange(*FEATURES, "kind", "label").sortWithinPartitions(*FEATURES, "kind", "label"), "pii_examples")
    examples = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep").transform(taught)
    examples = examples.select("_features", "kind", "label", "_teach", "_weight")
    seen = {(row["_teach"], row["label"]) for row in examples.groupBy("_teach", "label").count().collect()}
    if len(seen) < 4:
        return None
    learner = GBTClassifier(
        featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=TREES, maxDepth=DEPTH, seed=11, predictionCol="_said"
    )
    trees = learner.fit(examples.filter("_teach")).setProbabilityCol("_probability").setRawPredictionCol("_raw")
    judged = trees.transform(examples.filter("NOT _teach")).select("kind", "label", "_weight", F.ceil(vector_to_array("_probability")[1] * 100).alias("percent"))
    counts = {(row["kind"], row["percent"], row["label"]): row["n"] for row in judged.groupBy("kind", "percent", "label").agg(F.sum("_weight").alias("n")).collect()}
    thresholds = {}
    for kind in KINDS:
        good, bad = 0, 0
        for percent in range(100, -1, -1):
            good, bad = good + counts.get((kind, percent, 1.0), 0), bad + counts.get((kind, percent, 0.0), 0)
            if good and good >= PRECISION * (good + bad):
                thresholds[kind] = max((percent - 1) / 100, LEAST_THRESHOLD)
    return Selector(trees, thresholds)


def find_spans(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """Spans of personal data of each distinct document: ROW_KEY, kind, start, end, base, probability (1 for base spans).

    Without a selector, one is fitted to the candidates of `docs`. Added spans don't overlap base spans; of equal ones, one stays.
    """
    found = stage(candidates(docs), "pii_candidates")
    selector = selector or fit(found)
    base = found.filter("base").select(*ROW_KEY, "kind", "start", "end", "base", F.lit(1.0).alias("probability"))
    if selector is None:
        return base
    added = selector.selected(found.filter("NOT base"))
    added = added.groupBy(*ROW_KEY, "kind", "start", "end", "base").agg(F.max("probability").alias("probability"))
    return _marked_free(base.unionByName(added)).filter("base OR _free").drop("_free")


def personal_data(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """One row per document: doc_id, spans (start, kind's place in KINDS, end, base, probability; by start, then kind).

    Null and empty texts have no spans. Repeated rows have the same spans; rows without an id are searched like others.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = find_spans(docs, selector).groupBy(*ROW_KEY).agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("kind"), "end", "base", "probability"))).alias("spans")
    )
    rows = identified(docs, ["doc_id"]).join(spans, list(ROW_KEY), "left").drop(*ROW_KEY)
    return rows.withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def described(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"] - 1), s["start"], s["end"])), ",")
