"""Models with fixed parameters, and the small formats: each has its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loopweave.catalog.base import longs, r, rounded
from loopweave.catalog.domain import RES, arm_sizes, edges, nodes
from loopweave.catalog.registry import cte, query
from loopweave.catalog.models import K, prior
from loopweave.catalog.signals import valid_bins
from loopweave.catalog.vectors import instances
from loopweave.functions.gaussian import normal_log_density
from loopweave.functions.scalar import name_has_suffix
from loopweave.operators import hmm, mixture
from loopweave.operators import linear as ln
from loopweave.session import materialize, scratch_path
from loopweave.sources import readers as rd
from loopweave.sources import writers as wr
from loopweave.workflows import chained

# --- linear models: weight j of feature i is a small fixed number ------------------------------

CLASSES = 3


def fixed_model(solver: int) -> ln.LinearModel:
    w = np.array([[((i * 7 + j * 13) % 11 - 5) / 4 for i in range(64)] for j in range(CLASSES)])
    return ln.LinearModel(solver, [float(j) for j in range(CLASSES)], w, 64)


cte(
    "c_decide",
    f"""select vec_id idx, j, list_sum([cast(embedding[i+1] as double)*(((i*7+j*13)%11)-5)/4.0::double for i in range(64)]) z
    from embeddings, (select unnest(range({CLASSES})) j)""",
)


@query(
    "linear_decisions",
    """select idx, j::bigint j, round(z,6)+0.0 z, (row_number() over (partition by idx order by z desc, j) = 1) chosen from c_decide""",
)
def linear_decisions(spark, d):
    out = ln.predict(instances(spark, d), fixed_model(2))
    long = out.select("idx", "prediction", F.posexplode("decision").alias("j", "z"))
    return rounded(longs(long, "j"), "z").select("idx", "j", "z", (F.col("prediction") == F.col("j")).alias("chosen"))


@query(
    "linear_probabilities",
    "select idx, j::bigint j, round((1/(1+exp(-z)))/sum(1/(1+exp(-z))) over (partition by idx),6)+0.0 p from c_decide",
)
def linear_probabilities(spark, d):
    out = ln.predict(instances(spark, d), fixed_model(0)).select("idx", F.posexplode("probability").alias("j", "p"))
    return rounded(longs(out, "j"), "p")


@query("file_model", "select idx, j::bigint j, round(z,6)+0.0 z from c_decide")
def file_model(spark, d):
    """A model saved, loaded and applied."""
    path = scratch_path(spark, "model").removeprefix("file:")
    wr.save_model(fixed_model(2), path)
    out = ln.predict(instances(spark, d), wr.load_model(path))
    return rounded(longs(out.select("idx", F.posexplode("decision").alias("j", "z")), "j"), "z")




# --- two correlated signals under fixed normal components -----------------------------------------

MEANS = ((0.5, 0.5), (2.0, 1.0), (4.0, 3.0))
COVS = ((1.0, 0.25, 0.5), (2.0, -0.5, 1.0), (1.5, 0.5, 2.0))
PAIRS = [(np.array(m), np.array([[a, b], [b, c]])) for m, (a, b, c) in zip(MEANS, COVS)]


def two_signals(spark, d):
    wide = valid_bins(spark, d)
    return wide.select("idx", "chrom", "pos", F.array(F.asinh("click"), F.asinh("view")).alias("features"))


def density_sql(x: str, y: str, k: int) -> str:
    (mx, my), (a, b, c) = MEANS[k], COVS[k]
    det = a * c - b * b
    q = f"({c}*({x}-{mx})*({x}-{mx})-2*{b}*({x}-{mx})*({y}-{my})+{a}*({y}-{my})*({y}-{my}))/{det}"
    return f"(-0.5*({q}+2*ln(2*pi())+ln({det}::double)))"


cte(
    "c_density",
    "select idx, chrom, pos, " + ", ".join(f"{density_sql('asinh(click)', 'asinh(\"view\")', k)} d{k}" for k in range(K)) + " from c_valid",
)


@query("normal_log_density", "select idx, " + ", ".join(f"round(d{k},6)+0.0 d{k}" for k in range(K)) + " from c_density")
def log_density(spark, d):
    out = two_signals(spark, d).select("idx", normal_log_density("features", PAIRS).alias("v"))
    return out.select("idx", *[r(F.col("v")[k]).alias(f"d{k}") for k in range(K)])


@query(
    "mixture_evidence",
    f"""with j as (select n.idx, p.k, case p.k when 0 then d0 when 1 then d1 else d2 end + ln(pow(p.r,0.5)+1e-250) v
      from c_density n join c_prior p on p.idx=n.idx)
    select idx, k::bigint k, round(exp(v)/sum(exp(v)) over (partition by idx),6)+0.0 p from j""",
)
def mixture_evidence(spark, d):
    out = mixture.posterior_with_evidence(two_signals(spark, d), PAIRS, prior(spark, d), 1.0)
    return rounded(longs(out.select("idx", F.posexplode("post").alias("k", "p")), "k"), "p")


START = (0.5, 0.3, 0.2)
TRANS = ((0.8, 0.15, 0.05), (0.1, 0.8, 0.1), (0.05, 0.15, 0.8))


def _step(target: int) -> str:
    ways = [f"(f.s{a}+ln({TRANS[a][target]}::double))" for a in range(K)]
    return f"greatest({','.join(ways)})", f"case greatest({','.join(ways)}) when {ways[0]} then 0 when {ways[1]} then 1 else 2 end"


_best = ", ".join(f"{_step(k)[0]}+e.d{k}, {_step(k)[1]}" for k in range(K))
_cols = ", ".join(f"s{k}, b{k}" for k in range(K))
_first = ", ".join(f"ln({START[k]}::double)+e.d{k}, 0" for k in range(K))


@query(
    "markov_path",
    f"""with recursive runs as materialized (select *, pos - row_number() over (partition by chrom order by pos) run from c_density),
    e as materialized (select *, row_number() over (partition by chrom, run order by pos) t, count(*) over (partition by chrom, run) n from runs),
    f(chrom, run, t, n, idx, {_cols}) as (
      select chrom, run, t, n, idx, {_first} from e where t = 1
      union all select e.chrom, e.run, e.t, e.n, e.idx, {_best} from f join e on e.chrom=f.chrom and e.run=f.run and e.t=f.t+1),
    p(chrom, run, t, idx, label) as (
      select chrom, run, t, idx, case greatest(s0,s1,s2) when s0 then 0 when s1 then 1 else 2 end from f where t = n
      union all select f.chrom, f.run, f.t, f.idx, case p.label when 0 then g.b0 when 1 then g.b1 else g.b2 end
      from p join f g on g.chrom=p.chrom and g.run=p.run and g.t=p.t join f on f.chrom=p.chrom and f.run=p.run and f.t=p.t-1)
    select idx, label::bigint as label from p""",
)
def markov_path(spark, d):
    """Most probable states under fixed parameters; chains are cut into blocks of 64 bins."""
    frame = materialize(two_signals(spark, d))
    blocks = hmm.pack_chains(chained(frame).select("chain", "n", "t", "idx", "features"), block=64)
    params = hmm.HmmParams(np.array(START), np.array(TRANS), np.array(MEANS), np.stack([c for _, c in PAIRS]))
    return hmm.decode(blocks, params)


# --- small formats --------------------------------------------------------------------------------


@query("file_arm_sizes", "select chrom, arm, cast(size as bigint) size from c_arms")
def file_arm_sizes(spark, d):
    path = scratch_path(spark, "arms")
    wr.write_tsv(arm_sizes(spark, d).select("chrom", "arm", "size"), path)
    return rd.read_arm_sizes(spark, path)


@query("file_interactions", "select id1, id2, round(weight,6)+0.0 weight from c_edges")
def file_interactions(spark, d):
    path = scratch_path(spark, "interactions")
    wr.write_edges(edges(spark, d), path)
    return rounded(rd.tsv(spark, path, "id1 bigint, id2 bigint, weight double"), "weight")


@query(
    "file_gene_info",
    """select cast(p_partkey as varchar) gene_id, p_brand chr, cast(p_size as bigint) as start, cast(p_size+10 as bigint) "end",
    case when p_partkey%2=0 then '+' else '-' end strand, p_type as type from part""",
)
def file_gene_info(spark, d):
    path = scratch_path(spark, "gene-info")
    part = spark.read.parquet(f"{d}/part.parquet")
    strand = F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-")
    rows = part.select("p_partkey", "p_brand", "p_size", F.col("p_size") + 10, strand, "p_type", F.lit("more"))
    wr.write_tsv(rows, path)
    return rd.read_gene_info(spark, path)


@query("file_expression_table", "select cast(p_partkey as varchar) gene, cast(p_size as varchar) e1, p_brand e2 from part")
def file_expression_table(spark, d):
    path = scratch_path(spark, "expression")
    part = spark.read.parquet(f"{d}/part.parquet")
    wr.write_tsv(part.select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("e1"), F.col("p_brand").alias("e2")), path, header=True)
    return rd.read_expression_table(spark, path)


@query("file_bias", f"select 'chr'||chrom chrom, pos*{RES}+{RES // 2} mid, round(1.0/(1+idx%7),6)+0.0 bias from c_nodes")
def file_bias(spark, d):
    path = scratch_path(spark, "bias")
    bins = nodes(spark, d).select("idx", F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), (F.col("pos") * RES + RES // 2).alias("mid"))
    wr.write_bias(bins.select("idx", (1.0 / (1 + F.col("idx") % 7)).alias("bias")), bins, path)
    return rounded(rd.tsv(spark, path, "chrom string, mid bigint, bias double"), "bias")


@query(
    "name_suffixes",
    """select page_id, regexp_extract(url, '[^/]*$') like '%.html' and regexp_extract(url, '[^/]*$') like '%.%' as html from pages""",
)
def name_suffixes(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", name_has_suffix(F.col("url"), "html").alias("html"))
