"""Personal data: base spans by pattern, and terms that give protected values away.

Base spans (email, ip, card, phone) are found by SQL functions alone: matches
come from regexp_extract_all, their places from running sums over the lengths of
the matches and of the pieces that split leaves around them. The sums go by
blocks, and arrays that functions look into are columns of their own, so that
time grows in proportion to matches and lines, however many a text has.

Information-theoretic part: every base value is a protected entity e. Over all
N documents, the pointwise mutual information of e and a term t on its lines is
PMI = log2(N n(e,t) / n(e) n(t)), and e's own information is IC = log2(N / n(e)),
n being numbers of documents. A term that was seen with e in LEAST_CONTEXTS
different texts (copies of a text are no further evidence) discloses e if
PMI >= IC / ALPHA. On lines with e such a term becomes a span: it is removed if
it occurs with e only, otherwise generalised.

Everything is DataFrame functions; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import materialize

ALPHA = 1.25
LEAST_CONTEXTS = 3
LEAST_TERM = 3
KINDS = ("email", "ip", "card", "phone")

# The given patterns. Possessive repeats and the condition that a match begins where its run of characters begins (or
# the last match ended) change no match: they keep long runs from being read again from each of their characters, and
# repeats of groups from using the stack.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"\p{L}+"


_INTS = "array<int>"
#: Elements of a running sum's block.
SUMMED = 64


def with_running_sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with each of these columns, arrays of lengths, replaced by its running sums (each with its own element).

    Each step's arrays are used twice or more in the next, so the planner doesn't put them back into the functions that
    would then make them anew for every element.
    """
    others = [c for c in rows.columns if c not in names]
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast(_INTS))

    def block_sums(c):
        n = F.ceil(F.size(c) / SUMMED).cast("int")
        return F.transform(up_to(n), lambda b: add(F.slice(c, b * SUMMED + 1, SUMMED))).alias(f"{c}_blocks")

    def sums_before(c):
        return F.transform(up_to(F.size(f"{c}_blocks")), lambda b: add(F.slice(f"{c}_blocks", F.lit(1), b))).alias(f"{c}_before")

    rows = rows.select(*others, *names, *[block_sums(c) for c in names])
    rows = rows.select(*others, *names, *[sums_before(c) for c in names])

    def sums(c):
        def block(b):
            n = F.least(F.size(c) - b * SUMMED, F.lit(SUMMED))
            return F.transform(F.sequence(F.lit(1), n), lambda i: F.get(F.col(f"{c}_before"), b) + add(F.slice(c, b * SUMMED + 1, i)))

        return F.flatten(F.transform(up_to(F.size(f"{c}_before")), block)).alias(c)

    return rows.select(*others, *[sums(c) for c in names])


def with_found(rows: DataFrame, text_col: str, patterns: dict[str, str], possible: dict) -> DataFrame:
    """``rows`` with a column for each pattern: ``(start, end, value)`` of its leftmost non-overlapping matches, in code points.

    ``possible``: for each pattern a condition without which the text has no match.
    """
    text, others = F.col(text_col), rows.columns
    matches = [
        x for k, p in patterns.items() for x in (
            F.when(possible[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"{k}_values"),
            F.when(possible[k], F.split(text, p, -1)).otherwise(F.array().cast("array<string>")).alias(f"{k}_gaps"),
        )
    ]
    rows = rows.select(*others, *matches)
    size = lambda k: F.zip_with(F.slice(f"{k}_gaps", F.lit(1), F.size(f"{k}_values")), f"{k}_values", lambda g, v: F.length(g) + F.length(v))
    rows = rows.select(*others, *[f"{k}_values" for k in patterns], *[size(k).alias(f"{k}_ends") for k in patterns])
    rows = with_running_sums(rows, [f"{k}_ends" for k in patterns])
    span = lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value"))
    return rows.select(*others, *[F.zip_with(f"{k}_values", f"{k}_ends", span).alias(k) for k in patterns])


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits):
    def weighed(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _passes(kind: str, value):
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _possible(kind: str, text):
    """A cheap test that every text with a valid match of the kind passes."""
    return {
        "email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "phone": text.contains("+"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    }[kind]


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def with_base_spans(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """``rows`` with all base spans as ``(start, kind number, end, value)``, by start, then kind as listed."""
    others = rows.columns
    rows = with_found(rows, text_col, PATTERNS, {k: _possible(k, F.col(text_col)) for k in KINDS})

    def of_kind(n, kind):
        kept = F.filter(F.col(kind), lambda s: _passes(kind, s["value"]))
        return F.transform(
            kept, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
        )

    return rows.select(*others, F.array_sort(F.concat(*[of_kind(n, kind) for n, kind in enumerate(KINDS)])).alias(name))


def _written(spans):
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _terms(line):
    return F.filter(F.array_distinct(F.split(F.lower(line), r"\P{L}+")), lambda w: F.length(w) >= LEAST_TERM)


def disclosing_terms(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """``(lines, pairs)``: lines with base spans, and the entity-term pairs that disclose (None if there are none).

    lines: ``text_key, line_start, line, entity, copies``; pairs: ``entity, term, only``
    (only: the term occurs with the entity alone).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"))
    may = _possible("email", F.col("text")) | _possible("ip", F.col("text")) | _possible("card", F.col("text")) | _possible("phone", F.col("text"))
    # no base pattern crosses a line end, so a line's spans are the text's spans on that line
    split = texts.where(may).select(F.md5(F.col("text").cast("binary")).alias("text_key"), F.split("text", "\n").alias("lines"))
    split = with_running_sums(split.select("text_key", "lines", F.transform("lines", lambda x: F.length(x) + 1).alias("ends")), ["ends"])
    line = F.zip_with("lines", "ends", lambda x, e: F.struct(x.alias("line"), (e - F.length(x) - 1).alias("line_start")))
    # outer explosions: for others the planner makes a filter of the array, and works it out a second time below
    held = split.select("text_key", F.explode_outer(line).alias("x")).select("text_key", "x.line", "x.line_start").where(F.col("line").rlike("[0-9@]"))
    held = with_base_spans(held, "line", "spans")
    entity = F.transform("spans", lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(F.regexp_replace(s["value"], "[^A-Za-z0-9@.]", ""))))
    lines = materialize(
        held.select("text_key", "line_start", "line", F.explode_outer(F.array_distinct(entity)).alias("entity"))
        .where("entity is not null").groupBy("text_key", "line_start", "line", "entity").agg(F.count("*").alias("copies")), "lines",
    )
    seen = lines.select("text_key", "entity", "copies", F.explode(_terms(F.col("line"))).alias("term"))
    seen = seen.groupBy("text_key", "entity", "term").agg(F.max("copies").alias("copies"))
    together = seen.groupBy("entity", "term").agg(F.sum("copies").alias("n_et"), F.count("*").alias("contexts")).where(
        F.col("contexts") >= LEAST_CONTEXTS
    )
    n_e = lines.groupBy("text_key", "entity").agg(F.max("copies").alias("copies")).groupBy("entity").agg(F.sum("copies").alias("n_e"))
    n = texts.count()
    # PMI >= IC / ALPHA says n(t) <= n(e,t) (N / n(e))^(1 - 1/ALPHA); the documents with t on lines that hold base values
    # are a part of n(t), so terms of which these alone are too many need not be counted over the corpus
    on_lines = seen.groupBy("text_key", "term").agg(F.max("copies").alias("copies")).groupBy("term").agg(F.sum("copies").alias("m_t"))
    most = F.col("n_et") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - 1 / ALPHA)) * (1 + 1e-9)
    together = together.join(n_e, "entity").withColumn("most", most).where((F.col("n_e") < n))
    together = materialize(together.join(on_lines, "term").where("m_t <= most").select("entity", "term", "n_et", "n_e", "most"), "together")
    if together.isEmpty():  # no term was seen often enough with any value: nothing to weigh
        return lines, None
    # counted first and joined then: what is sent is a row for each word and task, whatever the number of candidates
    n_t = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    pairs = (
        together.join(n_t, "term").where("n_t <= most")
        .select("entity", "term", (F.col("n_et") == F.col("n_t")).alias("only"))
    )
    return lines, materialize(pairs, "pairs")


def _term_spans(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """``text_key, terms``: spans (kind 4, value: the label that replaces it) of disclosing terms of each text."""
    joined = lines.join(pairs, "entity").groupBy("text_key", "line_start", "line").agg(
        F.collect_set(F.when(F.col("only"), F.col("term"))).alias("removed"), F.collect_set("term").alias("terms")
    )
    joined = with_found(joined, "line", {"words": _WORD}, {"words": F.lit(True)})
    words = F.filter("words", lambda s: F.array_contains("terms", F.lower(s["value"])))
    label = lambda s: F.when(F.array_contains("removed", F.lower(s["value"])), "").otherwise("[TERM]")
    at = F.col("line_start")
    spans = F.transform(
        words, lambda s: F.struct((at + s["start"]).alias("start"), F.lit(len(KINDS)).alias("kind"), (at + s["end"]).alias("end"), label(s).alias("value"))
    )
    return joined.select("text_key", spans.alias("s")).groupBy("text_key").agg(F.flatten(F.collect_list("s")).alias("terms"))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = with_base_spans(rows.withColumn("text_key", F.md5(F.col("text").cast("binary"))), "text", "base")
    lines, pairs = disclosing_terms(docs, text_col)
    if pairs is None or pairs.isEmpty():
        return rows.withColumn("terms", F.array().cast(_SPANS))
    if not keep_text:
        rows = materialize(rows.drop("text"), "base")
    return rows.join(_term_spans(lines, pairs), "text_key", "left").withColumn(
        "terms", F.coalesce("terms", F.array().cast(_SPANS))
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term`` of every row.

    Null texts count as empty (no spans; the hash is that of the empty string);
    repeated rows stay and are treated alike; an empty table gives no rows;
    other columns are ignored.
    """
    rows = _with_spans(docs, id_col, text_col, False)

    def count(n):
        return F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    return rows.select(
        "doc_id", *[count(n) for n in range(len(KINDS))], F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: base values replaced by their kind in brackets, disclosing terms generalised or removed.

    Where spans overlap, the first decides and the rest of the others is dropped with it.
    """
    rows = _with_spans(docs, id_col, text_col, True)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        label = F.coalesce(F.get(names, s["kind"]), s["value"])
        kept = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), label)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, kept).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    spans = F.array_sort(F.concat("base", "terms"))
    return rows.select("doc_id", F.aggregate(spans, begin, step, end).alias("text"))
