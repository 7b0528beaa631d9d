"""Gene dependency scores: summaries, essential genes, correlation and co-dependency."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .scale import cut_lineage
from .topk import top_k

PAIR_SCHEMA = "gene string, partner string, n_common long, correlation double"
PAIR_TYPES = pa.schema([
    ("gene", pa.string()), ("partner", pa.string()), ("n_common", pa.int64()), ("correlation", pa.float64()),
])
SUMS_COLUMNS = ["gene", "partner", "n", "sx", "sy", "sxx", "syy", "sxy"]
SUMS_SCHEMA = "gene string, partner string, n long, sx double, sy double, sxx double, syy double, sxy double"
# Cells of the score matrix that one task of the correlation jobs may hold.
CELLS_PER_TASK = 1_000_000
GENES_PER_BLOCK = 512


def with_cancer(matrix: DataFrame, cell_lines: DataFrame) -> DataFrame:
    """Cancer type of each score; a cell line without a row gets ``Unknown``, a blank stays blank."""
    info = cell_lines.select("cell_line", F.coalesce("cancer_type", F.lit("")).alias("_cancer"))
    return (
        matrix.join(info, "cell_line", "left")
        .withColumn("cancer_type", F.coalesce("_cancer", F.lit("Unknown")))
        .drop("_cancer")
    )


def gene_summary(matrix: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    essential = F.count_if(F.col("score") < settings.essentiality_threshold)
    return matrix.groupBy("gene").agg(
        F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        essential.alias("essential_count"),
        (essential / F.count("*") * 100).alias("essential_pct"),
        F.count("*").alias("total_cell_lines"),
    )


def essential_by_cancer(
    matrix: DataFrame, cell_lines: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """(gene, cancer_type, n): essential cell lines by cancer type."""
    hits = matrix.where(F.col("score") < settings.essentiality_threshold)
    return with_cancer(hits, cell_lines).groupBy("gene", "cancer_type").agg(F.count("*").alias("n"))


def essential_cancers(histogram: DataFrame) -> DataFrame:
    """(gene, essential_cancers map): one entry for each cancer type of the gene."""
    return histogram.groupBy("gene").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cancer_type", "n")))).alias(
            "essential_cancers"
        )
    )


def top_cancers(histogram: DataFrame, n: int = 5) -> DataFrame:
    return top_k(histogram, n, ["gene"], [F.desc("n"), F.asc("cancer_type")])


def cancer_specific(
    matrix: DataFrame, cell_lines: DataFrame, cancer: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """Summary over the cell lines whose cancer type contains ``cancer``, case ignored."""
    info = cell_lines.where(F.lower("cancer_type").contains(cancer.lower())).select("cell_line")
    return (
        matrix.join(info, "cell_line", "left_semi")
        .groupBy("gene")
        .agg(
            F.avg("score").alias("mean_score"),
            F.count_if(F.col("score") < settings.essentiality_threshold).alias("essential_count"),
            F.count("*").alias("total"),
        )
        .withColumn("cancer_type", F.lit(cancer))
    )


def top_essential(summary: DataFrame, threshold: float | None = None, k: int = 50,
                  settings: Settings = DEFAULTS) -> DataFrame:
    limit = settings.essentiality_threshold if threshold is None else threshold
    return (
        summary.where(F.col("mean_score") < limit)
        .select("gene", "mean_score", "essential_pct")
        .orderBy(F.asc("mean_score"), F.asc("gene"))
        .limit(k)
    )


def _deal(matrix: DataFrame) -> tuple[int, int]:
    """Numbers of gene blocks and of cell line chunks: two blocks over one chunk fit one task."""
    genes, lines = matrix.agg(
        F.approx_count_distinct("gene"), F.approx_count_distinct("cell_line")
    ).first()
    genes, lines = max(1, int(genes * 1.1)), max(1, int(lines * 1.1))
    per_block = min(GENES_PER_BLOCK, genes)
    per_chunk = max(1, CELLS_PER_TASK // (2 * per_block))
    return -(-genes // per_block), -(-lines // per_chunk)


def _block(gene: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(gene), F.lit(blocks)).cast("int")


def _dealt_scores(matrix: DataFrame, blocks: int, chunks: int) -> DataFrame:
    """A copy of each score for every pair of blocks that its gene's block takes part in.

    The number of copies depends on the genes only; more cell lines give more chunks.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    chunk = F.pmod(F.xxhash64("cell_line"), F.lit(chunks)).cast("int").alias("chunk")
    return matrix.where("gene is not null and cell_line is not null").select(
        "gene", "cell_line", "score", _block("gene", blocks).alias("home"), chunk, every
    ).select(
        "gene", "cell_line", "score", "home",
        F.least("home", "other").alias("bi"), F.greatest("home", "other").alias("bj"), "chunk",
    )


def _dealt_pairs(pairs: DataFrame, blocks: int, chunks: int = 1) -> DataFrame:
    a, b = _block("gene", blocks), _block("partner", blocks)
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    return pairs.select(
        F.col("gene_a").alias("gene"), F.col("gene_b").alias("partner")
    ).distinct().select("gene", "partner", F.least(a, b).alias("bi"), F.greatest(a, b).alias("bj"), every)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings of a column, and the number of each row's."""
    coded = pa.concat_arrays([c.cast(pa.string()) for c in column.chunks] or [pa.array([], pa.string())])
    coded = coded.dictionary_encode()
    names, number = np.unique(np.asarray(coded.dictionary.to_pylist(), dtype=object), return_inverse=True)
    return names, number[coded.indices.to_numpy()] if len(coded) else np.empty(0, dtype=np.int64)


def _rows_of(cells: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gene names, their blocks, and the score and presence rows over the cell lines."""
    names, gene_of = _coded(cells.column("gene"))
    lines, line_of = _coded(cells.column("cell_line"))
    home = np.full(len(names), -1)
    home[gene_of] = cells.column("home").to_numpy()
    x = np.zeros((len(names), len(lines)))
    seen = np.zeros_like(x)
    x[gene_of, line_of] = cells.column("score").to_numpy()
    seen[gene_of, line_of] = 1.0
    return names, home, x, seen


def _sums_of(names: np.ndarray, i: np.ndarray, j: np.ndarray, sums: list[np.ndarray]) -> pa.Table:
    texts = pa.array(names, pa.string())
    columns = [texts.take(pa.array(i)), texts.take(pa.array(j)), pa.array(sums[0].astype(np.int64))]
    return pa.table([*columns, *map(pa.array, sums[1:])], names=SUMS_COLUMNS)


def _asked_sums(key: tuple[pa.Scalar, ...], cells: pa.Table, asked: pa.Table) -> pa.Table:
    """Sums over one chunk of cell lines for the asked pairs."""
    names, _, x, seen = _rows_of(cells)
    values = pa.array(names, pa.string())
    at = [pc.index_in(asked.column(c), values) for c in ("gene", "partner")]
    both = pc.and_(pc.is_valid(at[0]), pc.is_valid(at[1]))
    i, j = (pc.filter(a, both).to_numpy().astype(np.int64) for a in at)
    sums = [np.empty(len(i)) for _ in range(6)]
    step = max(1, CELLS_PER_TASK // (4 * max(1, x.shape[1])))
    for start in range(0, len(i), step):
        own = slice(start, start + step)
        common = seen[i[own]] * seen[j[own]]
        a, b = x[i[own]] * common, x[j[own]] * common
        for total, part in zip(sums, (common, a, b, a * a, b * b, a * b)):
            total[own] = part.sum(axis=1)
    return _sums_of(names, i, j, sums)


def _products(a: np.ndarray, b: np.ndarray, x: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
    """n, sx, sy, sxx, syy and sxy of every gene of ``a`` with every gene of ``b``."""
    xa, xb, sa, sb = x[a], x[b], seen[a], seen[b]
    return [sa @ sb.T, xa @ sb.T, sa @ xb.T, (xa * xa) @ sb.T, sa @ (xb * xb).T, xa @ xb.T]


def _all_sums(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
    """Sums over one chunk of cell lines for every unordered pair of the genes of two blocks."""
    names, home, x, seen = _rows_of(cells)
    bi, bj = key[0].as_py(), key[1].as_py()
    a, b = np.flatnonzero(home == bi), np.flatnonzero(home == bj)
    i, j = np.triu_indices(len(a), 1) if bi == bj else map(np.ravel, np.indices((len(a), len(b))))
    return _sums_of(names, a[i], b[j], [s[i, j] for s in _products(a, b, x, seen)])


def _correlations(sums: DataFrame, settings: Settings) -> DataFrame:
    """(gene, partner, n_common, correlation) of sums over chunks of cell lines; null as in ``pair_correlation``."""
    totals = sums.groupBy("gene", "partner").agg(*[F.sum(c).alias(c) for c in SUMS_COLUMNS[2:]])
    n = F.nullif(F.col("n"), F.lit(0))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(F.col("vx") * F.col("vy"))
    enough = (F.col("n") >= settings.min_common_lines) & (F.col("vx") > 1e-12) & (F.col("vy") > 1e-12)
    return totals.withColumns({"vx": vx, "vy": vy}).withColumn("r", F.when(enough, r)).select(
        "gene", "partner", F.col("n").alias("n_common"), F.when(~F.isnan("r"), F.col("r")).alias("correlation")
    )


def pair_correlation(
    pairs: DataFrame, matrix: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Pearson correlation of given gene pairs over their common cell lines.

    NULL for fewer than ten common lines or when one side does not vary. Pairs go to the tasks that
    hold the blocks of both genes, one for each chunk of cell lines, so no pair is spelled out over its
    cell lines; the chunks' sums are added up.
    """
    blocks, chunks = _deal(matrix)
    asked = pairs.select("gene_a", "gene_b").distinct()
    needed = cut_lineage(_dealt_pairs(asked, blocks, chunks))
    used = needed.select("bi", "bj").distinct()
    scores = _dealt_scores(matrix, blocks, chunks).join(used, ["bi", "bj"], "left_semi")
    sums = (
        scores.groupBy("bi", "bj", "chunk")
        .cogroup(needed.groupBy("bi", "bj", "chunk"))
        .applyInArrow(_asked_sums, SUMS_SCHEMA)
    )
    found = _correlations(sums, settings).withColumnsRenamed({"gene": "gene_a", "partner": "gene_b"})
    return asked.join(found, ["gene_a", "gene_b"], "left").select(
        "gene_a", "gene_b", F.coalesce("n_common", F.lit(0).cast("long")).alias("n_common"),
        "correlation",
    )


def compare_genes(pairs: DataFrame, matrix: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Both summaries and the correlation of each pair."""
    summary = gene_summary(matrix, settings)
    sides = []
    for side in ("gene_a", "gene_b"):
        renamed = [
            F.col(c).alias(f"{side}_{c}") for c in summary.columns if c != "gene"
        ]
        sides.append(summary.select(F.col("gene").alias(side), *renamed))
    out = pair_correlation(pairs, matrix, settings)
    return out.join(sides[0], "gene_a", "left").join(sides[1], "gene_b", "left")


def codependency_topk(
    matrix: DataFrame, k: int, exclude: DataFrame | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Best correlated partners of every gene, without forming gene pairs as rows.

    Genes are dealt into blocks and every pair of blocks is one small matrix product; a task holds
    two blocks of genes over a chunk of the cell lines. With one chunk it returns k partners for each
    gene; else the sums of the chunks are added up first. ``exclude`` is a table of unordered pairs
    (gene_a, gene_b) that may not be returned.
    """
    blocks, chunks = _deal(matrix)
    scores = _dealt_scores(matrix, blocks, chunks)
    ranked = [F.desc("correlation"), F.asc("partner")]
    if chunks > 1:
        sums = scores.groupBy("bi", "bj", "chunk").applyInArrow(_all_sums, SUMS_SCHEMA)
        one = _correlations(sums, settings).where("correlation is not null").withColumn(
            "correlation", F.round("correlation", 6)
        )
        ways = [F.struct(F.col(g).alias("gene"), F.col(p).alias("partner"))
                for g, p in (("gene", "partner"), ("partner", "gene"))]
        best = one.select(F.explode(F.array(*ways)).alias("way"), "n_common", "correlation").select(
            "way.*", "n_common", "correlation"
        )
        if exclude is not None:
            known = [exclude.select(F.col(a).alias("gene"), F.col(b).alias("partner"))
                     for a, b in (("gene_a", "gene_b"), ("gene_b", "gene_a"))]
            best = best.join(known[0].unionByName(known[1]).distinct(), ["gene", "partner"], "left_anti")
        return top_k(best, k, ["gene"], ranked)
    if exclude is None:
        banned = matrix.sparkSession.createDataFrame(
            [], "gene string, partner string, bi int, bj int"
        )
    else:
        banned = _dealt_pairs(exclude, blocks)
    least = settings.min_common_lines

    def correlate(key: tuple[pa.Scalar, ...], cells: pa.Table, known: pa.Table) -> pa.Table:
        found = _block_partners(key[0].as_py(), key[1].as_py(), cells, known.to_pandas(), k, least)
        return pa.Table.from_pandas(found, preserve_index=False).cast(PAIR_TYPES)

    best = (
        scores.groupBy("bi", "bj")
        .cogroup(banned.groupBy("bi", "bj"))
        .applyInArrow(correlate, PAIR_SCHEMA)
    )
    return top_k(best, k, ["gene"], ranked)


def _block_partners(
    bi: int, bj: int, cells: pa.Table, known: pd.DataFrame, k: int, least: int
) -> pd.DataFrame:
    """Best k partners in one block for every gene of the other block, both ways."""
    names, home, x, seen = _rows_of(cells)
    a, b = np.flatnonzero(home == bi), np.flatnonzero(home == bj)
    n, sx, sy, sxx, syy, sxy = _products(a, b, x, seen)
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = np.round((sxy - sx * sy / n) / np.sqrt(vx * vy), 6)
    r[~((n >= least) & (vx > 1e-12) & (vy > 1e-12))] = np.nan
    r[names[a][:, None] == names[b][None, :]] = np.nan
    row_at = {g: i for i, g in enumerate(names[a])}
    col_at = {g: i for i, g in enumerate(names[b])}
    for left, right in ((known["gene"], known["partner"]), (known["partner"], known["gene"])):
        i, j = left.map(row_at), right.map(col_at)
        both = i.notna() & j.notna()
        r[i[both].astype(int), j[both].astype(int)] = np.nan

    i, j = np.nonzero(~np.isnan(r))
    found = pd.DataFrame({
        "gene": names[a][i], "partner": names[b][j],
        "n_common": n[i, j].astype(np.int64), "correlation": r[i, j],
    })
    if bi != bj:
        back = found.rename(columns={"gene": "partner", "partner": "gene"})
        found = pd.concat([found, back[found.columns]])
    found = found.sort_values(["gene", "correlation", "partner"], ascending=[True, False, True])
    return found.groupby("gene").head(k)
