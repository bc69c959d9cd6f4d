"""Personal data by candidate gradient boosting, with DataFrame and SQL functions only.

High-recall generators propose overlapping spans, boosted trees judge them by format and context, and thresholds
calibrated on held-back candidates select what is added to the spans that plain rules find.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import written

#: Kinds in the order in which spans with the same start are listed; the first four are the rules' own.
KINDS = ["email", "ip", "card", "phone", "secret"]

#: The rules' patterns, written so that the engine neither backtracks over a long run nor recurses: a match can only
#: begin where a run begins or the last match ended. A card shorter than 14 digits would fail anyway.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_PARTS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

#: Generators of candidates: values after a name of a secret, tokens of letters and digits, numbers like cards and
#: phones, and addresses in disguise.
CANDIDATES = {
    "named": r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?[ ]{0,3}[:=][ ]{0,3}[\"']?[^\s\"']{4,}",
    "token": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+",
    "number": r"(?<![0-9A-Za-z.+-])[0-9(][0-9().\x20-]{7,20}[0-9](?![0-9A-Za-z])",
    "disguised": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(](?:at|@)[\])] ?[a-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]++)++",
}
#: What a candidate becomes when it is added.
BECOMES = {"named": "secret", "token": "secret", "number": "phone", "disguised": "email"}
CONTEXT = 24

#: The trees' shape.
TREES, DEPTH = 12, 3
#: A kind's threshold is the least score whose held-back candidates at or above it are right this often.
PRECISION = 0.95
#: Matches whose places are summed in one go.
TOGETHER = 256
#: Two views of a candidate. Each has trees that are fitted on what the other view gives away.
FORMAT = ["length", "digits", "uppers", "lowers", "hexes", "distinct", "groups", "brackets", "luhn"]
CONTEXT_VIEW = ["named_before", "contact_before", "quoted", "plus_before", "word_before", "colon_before", "space_after", "stop_after"]
GENERATORS = ["of_named", "of_token", "of_number", "of_disguised"]


def located(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern as an array of ``(start, end, kind, match, before, after)``, in code points, the end exclusive.

    The pieces between matches give the offsets, which are summed by the TOGETHER, and the ends of the pieces the context:
    nothing is counted from the start of the text again, so the cost grows in proportion to the text."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = KINDS.index(kind) if kind in KINDS else KINDS.index("secret")
    shape = "array<struct<start: int, end: int, kind: int, match: string, before: string, after: string>>"

    def summed(found, pieces):
        def step(acc, i):
            gap, match = F.get(pieces, i), F.get(found, i)
            begin = acc["at"] + F.length(gap)
            end = begin + F.length(match)
            own = F.struct(begin.alias("start"), end.alias("end"), F.lit(number).alias("kind"), match.alias("match"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(4)).alias("after"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], own).alias("out"))

        def part(acc, k):
            first = k * TOGETHER
            begun = F.struct(acc["at"].alias("at"), F.expr(f"cast(array() as {shape})").alias("out"))
            done = F.aggregate(F.sequence(first, F.least(first + TOGETHER, F.size(found)) - 1), begun, step)
            return F.get(F.transform(F.array(done), lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out"))), F.lit(0))

        begun = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{shape}>)").alias("out"))
        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / TOGETHER).cast("int")), begun, part, lambda acc: F.flatten(acc["out"])))

    # Both arrays are made once for each text and named, so that no step splits the text again.
    made = F.transform(F.array(F.struct(found.alias("found"), pieces.alias("pieces"))), lambda x: summed(x["found"], x["pieces"]))
    return F.coalesce(F.get(made, F.lit(0)), F.expr(f"cast(array() as {shape})"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def worth(i):
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.when(F.length(digits) > 0, F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(IP_PARTS)
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(match))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _validator(kind: str):
    return lambda s: _valid(kind, s["match"])


#: Texts that lack this hold no match at all, which spares most texts the search.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def base_spans(text: Column) -> Column:
    """Spans of the rules, by start, then kind."""
    parts = []
    for kind, pattern in BASE.items():
        own = F.filter(located(text, pattern, kind), _validator(kind))
        has = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
        parts.append(F.when(has, own))
    empty = F.expr("cast(array() as array<struct<start: int, end: int, kind: int, match: string>>)")
    spans = F.concat(*(F.coalesce(F.transform(p, lambda x: F.struct(x["start"], x["end"], x["kind"], x["match"])), empty) for p in parts))
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], s["match"])))


def candidate_spans(text: Column) -> Column:
    """Spans of the generators with their context; a named value is narrowed to the value itself."""
    def described(name: str):
        def made(s):
            match = F.regexp_extract(s["match"], r"[:=][ ]{0,3}[\"']?([^\s\"']+)$", 1) if name == "named" else s["match"]
            start = s["end"] - F.length(match)
            before = F.right(F.concat(s["before"], F.left(s["match"], F.length(s["match"]) - F.length(match))), F.lit(CONTEXT))
            return F.struct(start.alias("start"), s["end"].alias("end"), F.lit(name).alias("generator"), match.alias("match"), before.alias("before"), s["after"].alias("after"))

        return made

    parts = [F.transform(located(text, pattern, "secret"), described(name)) for name, pattern in CANDIDATES.items()]
    return F.when(text.rlike("[0-9]|[=:]|[\\[(](?i:at|@)[\\])]"), F.concat(*parts))


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


_NAMED = "(?i)(password|passwd|pwd|token|secret|key)[\"']?[ ]{0,3}[:=][ ]{0,3}[\"']?$"


def _described(rows: DataFrame) -> DataFrame:
    """Format and context features of candidate rows ``(generator, match, before, after)``, and each view's own label.

    ``valid`` tells by form alone: 1 for keys, hex digests, mixed tokens, numbers with as many digits in groups as a
    phone's and addresses that end in a domain; 0 for other forms. ``announced`` tells by the surroundings alone: 1
    after the name of a secret, a word for a contact or a plus sign, 0 elsewhere."""
    m, before = F.col("match"), F.col("before")
    share = lambda signs: F.length(F.regexp_replace(m, f"[^{signs}]", "")) / F.greatest(F.length(m), F.lit(1))
    groups = F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)))
    digits = _digits(m)
    out = {
        "length": F.length(m), "digits": share("0-9"), "uppers": share("A-Z"), "lowers": share("a-z"), "hexes": share("0-9a-fA-F"),
        "distinct": F.size(F.array_distinct(F.split(m, ""))) / F.greatest(F.length(m), F.lit(1)), "groups": groups, "brackets": F.contains(m, F.lit("(")),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False)),
        "named_before": before.rlike(_NAMED), "contact_before": before.rlike(r"(?i)(tel|phone|call|mobile|fax|contact|reach|write|mail|card)[a-z]*[^a-z0-9]{1,4}([a-z]{1,4} )?$"),
        "quoted": before.rlike("[\"']$"), "plus_before": before.rlike(r"\+[0-9]{1,3}[ -]?$"), "word_before": before.rlike("(?i)[a-z] $"), "colon_before": before.rlike("[:=] {0,3}$"),
        "space_after": F.col("after").rlike(r"^\s"), "stop_after": F.col("after").rlike("^[.,;!?]"),
        **{f"of_{g}": F.col("generator") == g for g in CANDIDATES},
    }
    mixed = (F.col("uppers") > 0).cast("int") + (F.col("lowers") > 0).cast("int") + (F.col("digits") > 0).cast("int")
    secret = m.rlike("^A[KS]IA[0-9A-Z]{16}$") | m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | ((mixed == 3) & (F.col("length") >= 16)) | ((F.col("of_named") > 0) & (mixed >= 2) & (F.col("length") >= 8))
    valid = F.when(F.col("of_number") > 0, F.length(digits).between(10, 15) & (F.col("groups") >= 3)).when(F.col("of_disguised") > 0, m.rlike(r"(?i)(?:\.|dot[\])]) ?[a-z]{2,6}$")).otherwise(secret)
    announced = (F.col("named_before") > 0) | (F.col("contact_before") > 0) | (F.col("plus_before") > 0)
    rows = rows.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()})
    return rows.withColumns({"valid": valid.cast("double"), "announced": announced.cast("double")})


def fit(described: DataFrame) -> tuple[GBTClassificationModel, GBTClassificationModel, dict[str, float]] | None:
    """Trees over the format that know the candidates announced by their context, trees over the context that know the
    valid forms, and a threshold of their mean score for each generator; None if a view shows one label only.

    No tree sees what its label was made of. A fifth of all candidates is held back for the thresholds: there a candidate is
    right if both views say so and wrong if neither does. A kind that reaches PRECISION at no score adds nothing. The trees
    are fitted on all others; candidates with the same features are one row, whose weight is their number."""
    held_back = F.pmod(F.xxhash64("before", "match"), F.lit(5)) == 0
    columns = [*FORMAT, *CONTEXT_VIEW, *GENERATORS, "generator", "valid", "announced"]
    counted = written(described.groupBy(*columns, held_back.alias("held")).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    used = counted.where("not held")
    if used.select("valid").distinct().count() < 2 or used.select("announced").distinct().count() < 2:
        return None
    models = []
    for view, label in ((FORMAT, "announced"), (CONTEXT_VIEW, "valid")):
        seen = written(used.groupBy(*view, *GENERATORS, label).agg(F.sum("weight").alias("weight")))
        rows = VectorAssembler(inputCols=[*view, *GENERATORS], outputCol="features").transform(seen).withColumn("label", F.col(label))
        models.append(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=2, weightCol="weight").fit(rows))
    scored = _scored(counted.where("held and valid = announced"), *models).groupBy("generator", F.round("score", 3).alias("score"))
    held = scored.agg(F.sum(F.col("valid") * F.col("weight")).alias("right"), F.sum("weight").alias("n"))
    thresholds, sums = dict.fromkeys(CANDIDATES, 2.0), {g: [0.0, 0] for g in CANDIDATES}
    for r in held.orderBy("generator", F.desc("score")).collect():
        own = sums[r["generator"]]
        own[:] = own[0] + r["right"], own[1] + r["n"]
        if own[0] / own[1] >= PRECISION:
            thresholds[r["generator"]] = r["score"] - 0.0005
    return *models, thresholds


def _scored(described: DataFrame, by_format: GBTClassificationModel, by_context: GBTClassificationModel) -> DataFrame:
    for name, model, view in (("format_score", by_format, FORMAT), ("context_score", by_context, CONTEXT_VIEW)):
        made = model.transform(VectorAssembler(inputCols=[*view, *GENERATORS], outputCol="features").transform(described))
        described = made.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return described.withColumn("score", (F.col("format_score") + F.col("context_score")) / 2)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    The counts and ``base_sha256`` tell of the rules' spans; ``spans`` lists these and the added ones as
    ``kind:start:end`` by start, then kind, joined by commas, in code points. An added span never overlaps one of the
    rules or an earlier added one. Null and empty texts give zeros, the digest of an empty string and no spans. Rows
    with equal or null ids are told apart, so repeated rows give repeated results. Other columns are ignored. No rows
    give no rows. If the candidates show one label only in one view, only the rules' spans are given.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = written(texts.select("doc_id", F.monotonically_increasing_id().alias("row"), base_spans(text).alias("base"), candidate_spans(text).alias("candidates")))

    rows = found.where("size(candidates) > 0").select("row", F.transform("base", lambda s: F.struct(s["start"], s["end"])).alias("b"), F.explode("candidates").alias("c"))
    overlaps = F.exists("b", lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"]))
    described = written(_described(rows.select("row", "c.*", overlaps.cast("int").alias("in_base"))))
    fitted = fit(described)
    number = F.element_at(F.create_map(*(F.lit(x) for k, v in BECOMES.items() for x in (k, KINDS.index(v)))), F.col("generator"))
    kept_of = F.expr(
        "aggregate(array_sort(collect_list(struct(start, end, kind))), cast(array() as array<struct<start: int, end: int, kind: int>>),"
        " (a, s) -> if(size(a) > 0 and s.start < element_at(a, -1).end, a, array_append(a, s)))"
    )
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    out = found.select("doc_id", "row", F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("base"))
    if fitted:
        *models, thresholds = fitted
        least = F.create_map(*(F.lit(x) for pair in thresholds.items() for x in pair))
        chosen = _scored(described.where("in_base = 0"), *models).where(F.col("score") >= least[F.col("generator")]).withColumn("kind", number)
        added = written(chosen.groupBy("row").agg(kept_of.alias("added")).select("row", F.transform("added", lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("added")))
        out = out.join(added, "row", "left").withColumn("added", F.coalesce("added", empty))
    else:
        out = out.withColumn("added", empty)
    counts = {f"n_{k}": F.size(F.filter("base", _of_kind(i))).cast("long") for i, k in enumerate(KINDS[:4])}
    return out.select(
        "doc_id", *(v.alias(k) for k, v in counts.items()),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``found(doc_id, spans)`` replaced by its kind in brackets; ids must be unique.

    Of overlapping spans the first stands for all. Rows without spans, with a null id or text stay as they are."""
    spans = found.where("spans <> ''").select(F.col("doc_id").alias("pii_id"), F.split("spans", ",").alias("pii_spans"))
    both = docs.join(spans, F.col(id_col) == F.col("pii_id"), "left")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        p = F.split(s, ":")
        begin, end = p[1].cast("int"), p[2].cast("int")
        there = F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), F.lit("["), p[0], F.lit("]"))
        return F.when(begin < acc["at"], F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(end.alias("at"), there.alias("out")))

    new = F.aggregate("pii_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return both.withColumn(text_col, F.when(F.col("pii_spans").isNotNull() & text.isNotNull(), new).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
