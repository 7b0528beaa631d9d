"""Reading stored model outputs: triplets, verdicts, intents, answers, fenced JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, blank_to_null, strip

ISSUE_TYPE = "struct<type:string,description:string,suggestion:string>"
DEFAULT_ISSUE = "verification_issue"

# Texts of the feedback.
NO_ISSUE_DESCRIPTION = "Verifier returned FAIL but did not provide structured issues."
NO_ISSUE_SUGGESTION = (
    "Regenerate the answer by grounding claims more explicitly in the provided context."
)
FEEDBACK_HEAD = "The previous answer had issues that need to be addressed:"
FEEDBACK_SUGGESTIONS = "Suggestions for improvement:"
FEEDBACK_TAIL = "Please regenerate a better answer addressing these issues."
FEEDBACK_NO_DETAIL = (
    "The previous answer was evaluated as FAIL but no specific issues were identified. "
    "Please review the context carefully and regenerate a more accurate and rigorous answer."
)


def parse_triplets(raw: Column | str) -> Column:
    """``subject|relation|object`` lines as an array of structs, in order."""
    parts = F.transform(
        F.split(as_col(raw), "\n"), lambda s: F.transform(F.split(s, r"\|"), strip)
    )
    good = F.filter(parts, lambda p: (F.size(p) == 3) & F.forall(p, lambda x: x != ""))
    return F.transform(
        good,
        lambda p, i: F.struct(
            p[0].alias("subject"), p[1].alias("relation"), p[2].alias("object"), i.alias("pos")
        ),
    )


def fenced_json(raw: Column | str) -> Column:
    """The JSON text of an output (inside a code fence if there is one); NULL if invalid."""
    c = as_col(raw)
    inner = F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*```", 1)
    text = F.when(c.rlike(r"(?s)```json\s*.*?\s*```"), inner).otherwise(c)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def parse_fenced_json(raw: Column | str, schema: str) -> Column:
    return F.from_json(fenced_json(raw), schema)


def _verdict_json_text(raw: Column) -> Column:
    text = strip(raw)
    fence = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"
    text = F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    text = F.when(text.startswith("{"), text).otherwise(
        F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    )
    return F.when(text.startswith("{") & text.endswith("}"), text)


def _clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def _issue(kind: Column, description: Column, suggestion: Column) -> Column:
    return F.struct(
        kind.alias("type"), description.alias("description"), suggestion.alias("suggestion")
    )


def _json_verdict(text: Column) -> Column:
    doc = F.try_parse_json(text)
    status = F.when(
        F.upper(strip(F.try_variant_get(doc, "$.status", "string"))) == "FAIL", "FAIL"
    ).otherwise("PASS")
    confidence = _clamp(
        F.coalesce(F.try_variant_get(doc, "$.confidence", "string").try_cast("double"), F.lit(0.8))
    )
    items = F.coalesce(
        F.try_variant_get(doc, "$.issues", "array<string>"), F.array().cast("array<string>")
    )
    parsed = F.transform(
        items,
        lambda s: F.when(
            s.startswith("{"),
            F.struct(
                F.from_json(s, ISSUE_TYPE).alias("item"), F.lit(True).alias("is_record")
            ),
        ).otherwise(
            F.struct(
                F.struct(
                    F.lit(DEFAULT_ISSUE).alias("type"),
                    s.alias("description"),
                    F.lit(None).cast("string").alias("suggestion"),
                ).alias("item"),
                F.lit(False).alias("is_record"),
            )
        ),
    )
    cleaned = F.transform(
        parsed,
        lambda p: _issue(
            F.coalesce(blank_to_null(p["item"]["type"]), F.lit(DEFAULT_ISSUE)),
            F.coalesce(strip(p["item"]["description"]), F.lit("")),
            F.when(p["is_record"], F.coalesce(strip(p["item"]["suggestion"]), F.lit(""))),
        ),
    )
    issues = F.filter(cleaned, lambda i: i["description"] != "")
    suggestions = F.array_distinct(
        F.filter(
            F.transform(cleaned, lambda i: i["suggestion"]),
            lambda s: s.isNotNull() & (s != ""),
        )
    )
    minimal = F.array(
        _issue(F.lit(DEFAULT_ISSUE), F.lit(NO_ISSUE_DESCRIPTION), F.lit(NO_ISSUE_SUGGESTION))
    )
    issues = F.when((status == "FAIL") & (F.size(issues) == 0), minimal).otherwise(issues)
    return F.when(
        doc.isNotNull(),
        F.struct(
            status.alias("status"),
            confidence.alias("confidence"),
            issues.alias("issues"),
            suggestions.alias("suggestions"),
        ),
    )


def _section_lines(raw: Column, pattern: str) -> Column:
    body = strip(F.regexp_extract(raw, pattern, 1))
    lines = F.transform(
        F.split(body, "\n"), lambda s: strip(F.regexp_replace(strip(s), "^-*•*", ""))
    )
    return F.filter(lines, lambda s: F.length(s) > 5)


def _text_verdict(raw: Column) -> Column:
    upper = F.upper(raw)
    stated = F.regexp_extract(upper, r"VERDICT\s*[:\-]?\s*(PASS|FAIL)", 1)
    status = (
        F.when(stated != "", stated)
        .when(upper.contains("FAIL") & ~upper.contains("PASS"), "FAIL")
        .otherwise("PASS")
    )
    number = F.regexp_extract(upper, r"CONFIDENCE\s*[:\-]?\s*([\d.]+)", 1)
    confidence = (
        F.when(number != "", F.coalesce(_clamp(number.try_cast("double")), F.lit(0.8)))
        .when(status == "PASS", 0.85)
        .otherwise(0.4)
    )
    issues = F.transform(
        _section_lines(raw, r"(?is)ISSUES?\s*[:\-]?\s*\n(.*?)(?=SUGGESTION|$)"),
        lambda s: _issue(F.lit(DEFAULT_ISSUE), s, F.lit(None).cast("string")),
    )
    suggestions = _section_lines(raw, r"(?is)SUGGESTIONS?\s*[:\-]?\s*\n(.*?)$")
    return F.struct(
        status.alias("status"),
        confidence.alias("confidence"),
        issues.alias("issues"),
        suggestions.alias("suggestions"),
    )


def parse_verdict(raw: Column | str) -> Column:
    """Verdict struct of a stored checker output: JSON if it holds any, else labelled text."""
    c = as_col(raw)
    return F.coalesce(_json_verdict(_verdict_json_text(c)), _text_verdict(c))


def needs_regeneration(verdict: Column | str) -> Column:
    v = as_col(verdict)
    return (v["status"] == "FAIL") | (v["confidence"] < 0.5)


def all_suggestions(verdict: Column | str) -> Column:
    """Distinct suggestions of the verdict and of its issues."""
    v = as_col(verdict)
    from_issues = F.filter(
        F.transform(v["issues"], lambda i: i["suggestion"]),
        lambda s: s.isNotNull() & (s != ""),
    )
    return F.array_distinct(F.concat(v["suggestions"], from_issues))


def regeneration_feedback(verdict: Column | str) -> Column:
    """Feedback text for a failed answer; NULL for a passed one."""
    v = as_col(verdict)
    bullets = F.transform(v["issues"], lambda i: F.concat(F.lit("- "), i["description"]))
    hints = F.transform(v["suggestions"], lambda s: F.concat(F.lit("- "), s))
    hint_lines = F.when(
        F.size(hints) > 0, F.concat(F.array(F.lit(""), F.lit(FEEDBACK_SUGGESTIONS)), hints)
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.lit(FEEDBACK_HEAD), F.lit("")),
        bullets,
        hint_lines,
        F.array(F.lit(""), F.lit(FEEDBACK_TAIL)),
    )
    empty = (F.size(v["issues"]) == 0) & (F.size(v["suggestions"]) == 0)
    return F.when(
        v["status"] != "PASS",
        F.when(empty, F.lit(FEEDBACK_NO_DETAIL)).otherwise(F.array_join(lines, "\n")),
    )


def normalize_intent(raw: Column | str) -> Column:
    upper = F.upper(strip(raw))
    return (
        F.when(upper.contains("SCIENTIFIC"), "SCIENTIFIC")
        .when(upper.contains("GENERAL"), "GENERAL")
        .otherwise("SCIENTIFIC")
    )


def normalize_answer(raw: Column | str, options: str = "yes_no") -> Column:
    """Answer reduced to its answer space: ``yes_no`` or ``letter`` (A to D)."""
    c = strip(raw)
    if options == "yes_no":
        return F.initcap(
            F.nullif(F.lower(F.regexp_extract(c, r"(?i)\b(yes|no)\b", 1)), F.lit(""))
        )
    labelled = F.regexp_extract(c, r"(?i)(?:answer|option)(?:\s+is)?\s*[:\-]?\s*\(?([A-D])\b", 1)
    bare = F.regexp_extract(c, r"\b([A-D])\b", 1)
    lone = F.regexp_extract(c, r"(?i)^\(?([a-d])\)?[.:]?$", 1)
    return F.upper(F.coalesce(*[F.nullif(x, F.lit("")) for x in (labelled, lone, bare)]))
