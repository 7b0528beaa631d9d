"""Rendering records as text blocks. Missing parts drop out through ``concat_ws``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, blank_to_null, let, line


def _present(value: Column | str, default: str) -> Column:
    return F.coalesce(as_col(value), F.lit(default))


def _labelled(label: str, value: Column | str, default: str) -> Column:
    return F.concat(F.lit(label), _present(value, default))


def _join_lines(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("\n", *cols)


def _lines_when(condition: Column, *parts: Column | str) -> Column:
    return F.when(condition, _join_lines(*parts))


# ---------------------------------------------------------------- web hits


def format_web_chunk(
    title: Column | str, date: Column | str, link: Column | str,
    crawled: Column | str, snippet: Column | str,
) -> Column:
    """Text chunk of a web hit: crawled text if there is any, else its snippet; NULL if neither."""
    deep = blank_to_null(crawled)
    body = F.coalesce(F.substring(deep, 1, 3000), blank_to_null(snippet))
    kind = F.when(deep.isNotNull(), "Deep Fetch (Full Abstract)").otherwise("Google Snippet")
    day = F.coalesce(F.nullif(F.trim(as_col(date)), F.lit("")), F.lit("Unknown Date"))
    return F.concat(
        F.lit("Title: "), _present(title, ""), F.lit("\nDate: "), day,
        F.lit("\nLink: "), _present(link, ""), F.lit("\nContent Type: "), kind,
        F.lit("\nBody: "), body, F.lit("\n"),
    )


def web_chunk_source(content: Column | str) -> Column:
    return F.when(as_col(content).contains("PMID:"), "pubmed").otherwise("web_search")


def format_hits(hits: Column | str) -> Column:
    """Numbered list of search hits (array of structs title, link, snippet)."""
    blocks = F.transform(
        as_col(hits),
        lambda h, i: _join_lines(
            F.concat((i + 1).cast("string"), F.lit(". "), _present(h["title"], "No title")),
            _labelled("   URL: ", h["link"], "N/A"),
            line("   ", h["snippet"]),
            "",
        ),
    )
    return F.when(F.size(as_col(hits)) == 0, "No search results found.").otherwise(
        F.concat(F.lit("Web Search Results:\n\n"), F.array_join(blocks, "\n"))
    )


# ---------------------------------------------------------------- articles


def format_citation(a: dict[str, Column | str]) -> Column:
    return F.concat_ws(
        ". ",
        blank_to_null(a["authors"]),
        blank_to_null(a["title"]),
        blank_to_null(a["journal"]),
        F.concat(F.lit("("), blank_to_null(a["year"]), F.lit(")")),
        line("PMID: ", a["pmid"]),
    )


def format_article(a: dict[str, Column | str]) -> Column:
    return _join_lines(
        _labelled("Title: ", a["title"], "Unknown"),
        line("Authors: ", a["authors"]),
        F.concat(
            F.lit("Journal: "), blank_to_null(a["journal"]),
            F.lit(" ("), _present(a["year"], "N/A"), F.lit(")"),
        ),
        _labelled("PMID: ", a["pmid"], "N/A"),
        line("\nAbstract:\n", a["abstract"]),
        "\n[Source: PubMed]",
    )


def format_preprint(p: dict[str, Column | str]) -> Column:
    return _join_lines(
        _labelled("Title: ", p["title"], "Unknown"),
        line("Authors: ", p["authors"]),
        line("Category: ", p["category"]),
        line("Posted: ", p["date"]),
        _labelled("DOI: ", p["doi"], "N/A"),
        line("\nAbstract:\n", p["abstract"]),
        F.concat(F.lit("\n[Source: "), _present(p["server"], "biorxiv"), F.lit("]")),
    )


ARTICLE_SCHEMA = """
  pmid string, title string,
  abstract array<struct<label:string,text:string>>,
  authors array<struct<last:string,initials:string,collective:string>>,
  journal string, year string
"""


def article_fields(payload: Column | str) -> Column:
    """Flat article struct of a stored article (JSON with labelled abstract parts and authors)."""
    a = F.from_json(as_col(payload), ARTICLE_SCHEMA)
    abstract = F.array_join(
        F.transform(
            a["abstract"],
            lambda s: F.concat(
                F.coalesce(F.concat(s["label"], F.lit(": ")), F.lit("")), s["text"]
            ),
        ),
        " ",
    )
    names = F.filter(
        F.transform(
            a["authors"],
            lambda p: F.when(
                p["last"].isNotNull() & p["initials"].isNotNull(),
                F.concat(p["last"], F.lit(" "), p["initials"]),
            ).otherwise(p["collective"]),
        ),
        lambda n: n.isNotNull(),
    )
    authors = F.concat(
        F.array_join(F.slice(names, 1, 5), ", "),
        F.when(F.size(a["authors"]) > 5, " et al.").otherwise(""),
    )
    return F.struct(
        a["pmid"].alias("pmid"),
        F.coalesce(a["title"], F.lit("")).alias("title"),
        F.coalesce(abstract, F.lit("")).alias("abstract"),
        F.coalesce(authors, F.lit("")).alias("authors"),
        F.coalesce(a["journal"], F.lit("")).alias("journal"),
        F.coalesce(a["year"], F.lit("")).alias("year"),
    )


# ---------------------------------------------------------------- trials

TRIAL_SCHEMA = """
  protocolSection struct<
    identificationModule:struct<nctId:string,officialTitle:string,briefTitle:string,
      orgStudyIdInfo:struct<id:string>>,
    descriptionModule:struct<briefSummary:string,detailedDescription:string>,
    statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>,
      completionDateStruct:struct<date:string>>,
    designModule:struct<studyType:string,phases:array<string>>,
    conditionsModule:struct<conditions:array<string>,keywords:array<string>>,
    armsInterventionsModule:struct<
      interventions:array<struct<type:string,name:string,description:string>>>,
    eligibilityModule:struct<eligibilityCriteria:string,minimumAge:string,maximumAge:string,
      sex:string>,
    outcomesModule:struct<
      primaryOutcomes:array<struct<measure:string,timeFrame:string,description:string>>,
      secondaryOutcomes:array<struct<measure:string,timeFrame:string,description:string>>>,
    sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>>
"""


def trial_fields(payload: Column | str) -> Column:
    """Twenty flat fields of a stored trial; absent texts become empty, absent lists stay empty."""
    p = F.from_json(as_col(payload), TRIAL_SCHEMA)["protocolSection"]
    ident, desc, status = p["identificationModule"], p["descriptionModule"], p["statusModule"]
    design, cond, elig = p["designModule"], p["conditionsModule"], p["eligibilityModule"]
    outcomes = p["outcomesModule"]

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    def items(c: Column, kind: str) -> Column:
        return F.coalesce(c, F.array().cast(kind))

    intervention = "array<struct<type:string,name:string,description:string>>"
    outcome = "array<struct<measure:string,timeFrame:string,description:string>>"
    return F.struct(
        ident["nctId"].alias("nct_id"),
        text(F.coalesce(ident["officialTitle"], ident["briefTitle"])).alias("title"),
        text(ident["orgStudyIdInfo"]["id"]).alias("org_study_id"),
        text(status["overallStatus"]).alias("status"),
        text(F.array_join(design["phases"], ", ")).alias("phase"),
        text(design["studyType"]).alias("study_type"),
        items(cond["conditions"], "array<string>").alias("conditions"),
        items(cond["keywords"], "array<string>").alias("keywords"),
        text(desc["briefSummary"]).alias("brief_summary"),
        text(desc["detailedDescription"]).alias("detailed_description"),
        items(p["armsInterventionsModule"]["interventions"], intervention).alias("interventions"),
        text(elig["eligibilityCriteria"]).alias("eligibility_criteria"),
        text(elig["minimumAge"]).alias("min_age"),
        text(elig["maximumAge"]).alias("max_age"),
        text(elig["sex"]).alias("sex"),
        items(outcomes["primaryOutcomes"], outcome).alias("primary_outcomes"),
        items(outcomes["secondaryOutcomes"], outcome).alias("secondary_outcomes"),
        text(status["startDateStruct"]["date"]).alias("start_date"),
        text(status["completionDateStruct"]["date"]).alias("completion_date"),
        text(p["sponsorCollaboratorsModule"]["leadSponsor"]["name"]).alias("lead_sponsor"),
    )


def trial_summary(payload: Column | str) -> Column:
    """Short projection used in trial search results."""
    p = F.from_json(as_col(payload), TRIAL_SCHEMA)["protocolSection"]
    return F.struct(
        F.coalesce(p["identificationModule"]["nctId"], F.lit("")).alias("nct_id"),
        F.coalesce(p["identificationModule"]["briefTitle"], F.lit("")).alias("title"),
        F.coalesce(p["statusModule"]["overallStatus"], F.lit("")).alias("status"),
        F.coalesce(F.array_join(p["designModule"]["phases"], ", "), F.lit("")).alias("phase"),
    )


def format_trial(trial: Column | str) -> Column:
    t = as_col(trial)
    arms = F.transform(
        t["interventions"],
        lambda x, i: _join_lines(
            F.concat(
                (i + 1).cast("string"), F.lit(". "), _present(x["type"], "Unknown"),
                F.lit(": "), _present(x["name"], "Unknown"),
            ),
            line("   Description: ", x["description"]),
        ),
    )
    outcomes = F.transform(
        F.slice(t["primary_outcomes"], 1, 3),
        lambda x: _join_lines(
            _labelled("- ", x["measure"], ""), line("  Time Frame: ", x["timeFrame"])
        ),
    )
    criteria = t["eligibility_criteria"]
    return _join_lines(
        _labelled("Clinical Trial: ", t["nct_id"], "Unknown"),
        "",
        _labelled("Official Title: ", t["title"], "N/A"),
        _labelled("Status: ", t["status"], "N/A"),
        line("Phase: ", t["phase"]),
        line("Study Type: ", t["study_type"]),
        line("Conditions: ", F.array_join(t["conditions"], ", ")),
        line("\nBrief Summary:\n", t["brief_summary"]),
        _lines_when(F.size(arms) > 0, "", "Interventions:", F.array_join(arms, "\n")),
        line("\nEligibility Criteria:\n", F.substring(criteria, 1, 1000)),
        F.when(F.length(criteria) > 1000, "..."),
        _lines_when(F.size(outcomes) > 0, "", "Primary Outcomes:", F.array_join(outcomes, "\n")),
        "",
        line("Start Date: ", t["start_date"]),
        line("Estimated Completion: ", t["completion_date"]),
        line("Sponsor: ", t["lead_sponsor"]),
        "",
        "[Source: ClinicalTrials.gov API v2]",
    )


# ---------------------------------------------------------------- knowledge graph records


def format_pair(r: dict[str, Column | str]) -> Column:
    return _join_lines(
        F.concat(
            F.lit("Synthetic Lethality: "), as_col(r["gene_a"]), F.lit(" ↔ "), as_col(r["gene_b"])
        ),
        _labelled("SL Score: ", as_col(r["sl_score"]).cast("string"), "N/A"),
        _labelled("Evidence: ", r["evidence_type"], "N/A"),
        line("PMID: ", r["pmid"]),
        F.concat(F.lit("[Source: "), _present(r["source"], "External KG"), F.lit("]")),
    )


def format_gene(r: dict[str, Column | str]) -> Column:
    score = as_col(r["essentiality_score"])
    return _join_lines(
        F.concat(
            F.lit("Gene: "), as_col(r["symbol"]), F.lit(" ("), _present(r["name"], ""), F.lit(")")
        ),
        _labelled("Function: ", r["function"], "N/A"),
        line("Pathway: ", r["pathway"]),
        F.when(score != 0, F.concat(F.lit("Essentiality Score: "), score.cast("string"))),
        "[Source: External KG]",
    )


def format_drug(r: dict[str, Column | str]) -> Column:
    return _join_lines(
        F.concat(
            F.lit("Drug-Gene Interaction: "), as_col(r["drug_name"]), F.lit(" → "),
            as_col(r["target_gene"]),
        ),
        _labelled("Type: ", r["interaction_type"], "N/A"),
        line("Mechanism: ", r["mechanism"]),
        line("Clinical Status: ", r["clinical_status"]),
        F.concat(F.lit("[Source: "), _present(r["source"], "External KG"), F.lit("]")),
    )


# ---------------------------------------------------------------- page layouts

LAYOUT_SCHEMA = """
  array<struct<type:string,markdown:string,content:string,caption:string,description:string,
    text:string,page_idx:int,rows:array<array<string>>>>
"""


def table_to_markdown(rows: Column | str) -> Column:
    """Markdown of a table given as rows of cells; ragged rows are padded or cut to the header."""
    cells = F.transform(
        as_col(rows), lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    )

    def row_text(values: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))

    def written(t: Column) -> Column:
        width = F.size(t[0])
        padded = F.transform(
            F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))),
            lambda r: row_text(
                F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
            ),
        )
        rule = row_text(F.array_repeat(F.lit("---"), width))
        return F.array_join(F.concat(F.array(row_text(t[0]), rule), padded), "\n")

    usable = (F.size(as_col(rows)) > 0) & (F.size(F.get(as_col(rows), F.lit(0))) > 0)
    return F.when(usable, let(cells, written)).otherwise("")


def layout_parts(content_list: Column | str) -> Column:
    """Tables, figure captions and first-page text of a stored page layout."""

    def parts(blocks: Column) -> Column:
        def texts(kind: str, value) -> Column:
            picked = F.filter(blocks, lambda b: b["type"] == kind)
            return F.filter(F.transform(picked, value), lambda s: s.isNotNull() & (s != ""))

        tables = texts(
            "table",
            lambda b: F.coalesce(b["markdown"], b["content"], table_to_markdown(b["rows"])),
        )
        figures = texts(
            "figure", lambda b: line("Figure: ", F.coalesce(b["caption"], b["description"]))
        )
        first_page = F.filter(
            F.transform(
                F.filter(blocks, lambda b: (b["type"] == "text") & (b["page_idx"] == 0)),
                lambda b: b["text"],
            ),
            lambda s: s.isNotNull() & (s != ""),
        )
        return F.struct(
            tables.alias("tables"), figures.alias("figures"), first_page.alias("first_page")
        )

    # the document is parsed once for all parts
    return let(F.from_json(as_col(content_list), LAYOUT_SCHEMA), parts)
