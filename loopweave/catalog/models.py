"""Balancing, propagation, random field, mixture and Markov model queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loopweave.catalog.base import r, rounded
from loopweave.catalog.domain import TRACKS, edges, nodes
from loopweave.catalog.graphs import graph
from loopweave.catalog.registry import cte, query
from loopweave.catalog.signals import valid_bins
from loopweave.operators import annotation as an
from loopweave.operators import balance as bl
from loopweave.operators import contacts as ct
from loopweave.operators import mixture, mprop, mrf
from loopweave.operators.tracks import feature_arrays
from loopweave.session import materialize, shuffles_dropped
from loopweave.workflows import label_bins


def equilibrate_sql(cells: str, rounds: int, head: str = "") -> str:
    steps = [f"x0 as materialized (select distinct id1 idx, 1.0::double x from {cells})"]
    for k in range(1, rounds + 1):
        steps.append(
            f"x{k} as materialized (select x.idx, sqrt(any_value(x.x)/sum(a.weight*y.x)) x from x{k - 1} x "
            f"join {cells} a on a.id1=x.idx join x{k - 1} y on y.idx=a.id2 group by x.idx)"
        )
    return f"with {head}" + ",\n".join(steps)


cte(
    "c_sym",
    "select id1,id2,sum(weight) weight from (select id1,id2,weight from c_edges union all select id2,id1,weight from c_edges) group by 1,2",
)


def symmetric(spark, d):
    return ct.sum_duplicates(ct.swap_union(edges(spark, d)))


@query("balance_fixed_point", equilibrate_sql("c_sym", 5) + " select idx, round(x,6)+0.0 x from x5")
def balance_fixed_point(spark, d):
    return rounded(bl.equilibrate(materialize(symmetric(spark, d)), 5), "x")


@query("balance_newton", equilibrate_sql("c_sym", 60) + " select idx, round(x,5)+0.0 x from x60")
def balance_newton(spark, d):
    return rounded(bl.balance(materialize(symmetric(spark, d)), tol=1e-9), "x", digits=5)


KEPT = """cs as materialized (select id1 idx, sum(weight) s from c_sym group by id1),
    lim as (select s from (select s, row_number() over (order by s, idx)-1 k from cs) where k=(select cast(floor(0.05*count(*)) as bigint) from cs)),
    rem as materialized (select idx from cs where s <= (select s from lim)),
    kept as materialized (select * from c_sym where id1 not in (select idx from rem) and id2 not in (select idx from rem)),
    """
cte(
    "c_bias",
    equilibrate_sql("kept", 60, KEPT)
    + """ select idx, (1/x)/(select avg(1/x) from x60) bias from x60 union all select idx, -1.0 from rem""",
)


@query("bias_vector", "select idx, round(bias,5)+0.0 bias from c_bias")
def bias_vector(spark, d):
    return rounded(bl.bias_vector(edges(spark, d), tol=1e-9), "bias", digits=5)


@query(
    "bias_check",
    """select round(avg(bias),5)+0.0 mean, round(quantile_cont(bias,0.5),5)+0.0 median, round(stddev_pop(bias),5)+0.0 std,
    avg(bias)<0.5 or avg(bias)>2 or quantile_cont(bias,0.5)<0.5 or quantile_cont(bias,0.5)>2 warning from c_bias""",
)
def bias_check(spark, d):
    return rounded(bl.bias_check(bl.bias_vector(edges(spark, d), tol=1e-9)), "mean", "median", "std", digits=5)


# --- propagation over the interaction graph ---------------------------------------------------

K = 3
cte(
    "c_prior",
    f"""select idx, k, v/sum(v) over (partition by idx) r from (
    select idx, k, 1+((idx*31+k*17)%10)::double v from c_nodes, (select unnest(range({K})) k)) where idx%3<>1""",
)


def prior(spark, d):
    v = [1 + ((F.col("idx") * 31 + k * 17) % 10).cast("double") for k in range(K)]
    return nodes(spark, d).filter("idx % 3 <> 1").select(
        "idx", F.array(*[x / (v[0] + v[1] + v[2]) for x in v]).alias("post")
    )


cte("c_sym_loose", "select id1,id2,weight from c_sym where id1<>id2")


def whole_map(spark, d):
    """The whole contact map in both directions, without loops."""
    return ct.without_loops(symmetric(spark, d))


def propagate_sql(rounds: int, links: str = "c_graph") -> str:
    steps = [
        f"""q0 as materialized (select i.idx, s.k, coalesce(p.r, 1.0/{K}) q, p.r from
      (select id1 idx from {links} union select idx from c_prior) i join (select unnest(range({K})) k) s on true
      left join c_prior p on p.idx=i.idx and p.k=s.k)"""
    ]
    for n in range(1, rounds + 1):
        steps.append(
            f"""p{n} as materialized (select idx, k, r, exp(b)/sum(exp(b)) over (partition by idx) p from (
      select q.idx, q.k, any_value(q.r) r, (coalesce(sum(e.weight*ln(j.q)),0)+ln(any_value(q.q)))/(coalesce(sum(e.weight),0)+1) b
      from q{n - 1} q left join {links} e on e.id1=q.idx left join q{n - 1} j on j.idx=e.id2 and j.k=q.k group by q.idx,q.k))"""
        )
        steps.append(
            f"""q{n} as materialized (select p.idx, p.k, any_value(p.r) r, (coalesce(any_value(p.r),0)+coalesce(sum(e.weight*j.p),0)+any_value(p.p))
      /(case when any_value(p.r) is null then 0 else 1 end + coalesce(sum(e.weight),0)+1) q
      from p{n} p left join {links} e on e.id2=p.idx left join p{n} j on j.idx=e.id1 and j.k=p.k group by p.idx,p.k)"""
        )
    return "with " + ",\n".join(steps)


@query(
    "measure_propagation",
    propagate_sql(5)
    + " select idx, " + ", ".join(f"round(max(case when k={k} then p end),6)+0.0 p{k}" for k in range(K))
    + " from p5 group by idx",
)
def measure_propagation(spark, d):
    out = mprop.propagate(materialize(graph(spark, d)), prior(spark, d))
    return out.select("idx", *[r(F.col("post")[k]).alias(f"p{k}") for k in range(K)])


@query(
    "measure_propagation_whole_map",
    propagate_sql(5, "c_sym_loose")
    + " select idx, " + ", ".join(f"round(max(case when k={k} then p end),6)+0.0 p{k}" for k in range(K))
    + " from p5 group by idx",
)
def measure_propagation_whole_map(spark, d):
    out = mprop.propagate(whole_map(spark, d), prior(spark, d))
    return out.select("idx", *[r(F.col("post")[k]).alias(f"p{k}") for k in range(K)])


POTENTIAL = np.log(np.array([[0.6, 0.25, 0.15], [0.25, 0.5, 0.25], [0.15, 0.25, 0.6]]))


def unary(spark, d):
    v = [-((F.col("idx") * 13 + k * 29) % 11).cast("double") / 5 for k in range(K)]
    return nodes(spark, d).select("idx", F.array(*v).alias("phi"))


PSI = "select * from (values {}) t(a,b,w)".format(
    ",".join(f"({a},{b},{float(POTENTIAL[a, b])!r}::double)" for a in range(K) for b in range(K))
)
PHI = f"select idx, k, -((idx*13+k*29)%11)::double/5 f from c_nodes, (select unnest(range({K})) k)"


def beliefs_sql(rounds: int = 20, links: str = "c_graph", psi: str = PSI, phi: str = PHI, head: str = "", tol: float = 1e-2) -> str:
    """Table ``b`` (idx, k, b) of the first round whose mean moves by less than ``tol``, else of the last.

    The operator may take 100 rounds; about ten are enough on the contact graphs, so the SQL stops at ``rounds``.
    """
    steps = [
        f"psi as materialized ({psi})",
        f"phi as materialized ({phi})",
        f"ed as materialized (select distinct id1 s, id2 t from {links} where id1<>id2)",
        f"m0 as materialized (select s, t, k, 0.0::double m from ed, (select unnest(range({K})) k))",
    ]
    for n in range(1, rounds + 1):
        steps.append(
            f"""b{n} as materialized (select idx, k, f-ln(sum(exp(f-top)) over (partition by idx))-top b from (
      select *, max(f) over (partition by idx) top from (
      select p.idx, p.k, any_value(p.f)+coalesce(sum(m.m),0) f from phi p left join m{n - 1} m on m.t=p.idx and m.k=p.k group by p.idx,p.k)))"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} as materialized (select e.s, e.t, psi.a k, any_value(c.c)+ln(sum(exp(psi.w+b.b-v.m-c.c))) m from ed e
      join b{n} b on b.idx=e.s join m{n - 1} v on v.s=e.t and v.t=e.s and v.k=b.k join psi on psi.b=b.k
      join (select e.s, e.t, max(b.b-v.m) c from ed e join b{n} b on b.idx=e.s join m{n - 1} v on v.s=e.t and v.t=e.s and v.k=b.k group by 1,2) c
        on c.s=e.s and c.t=e.t group by e.s,e.t,psi.a)"""
            )
    means = " union all ".join(f"select {n} n, sum(b)/count(distinct idx) s from b{n}" for n in range(1, rounds + 1))
    steps.append(f"means as materialized ({means})")
    steps.append(
        f"stop as materialized (select coalesce(min(n), {rounds}) n from (select n, abs(s-lag(s) over (order by n)) d from means) where d<{tol})"
    )
    steps.append(
        "b as materialized (" + " union all ".join(f"select * from b{n} where (select n from stop)={n}" for n in range(1, rounds + 1)) + ")"
    )
    return f"with {head}" + ",\n".join(steps)


PER_NODE = " select idx, " + ", ".join(f"round(max(case when k={k} then b end),6)+0.0 b{k}" for k in range(K)) + " from b group by idx"


@query("loopy_beliefs", beliefs_sql() + PER_NODE)
def loopy_beliefs(spark, d):
    out = mrf.loopy_beliefs(graph(spark, d), unary(spark, d), POTENTIAL)
    return out.select("idx", *[r(F.col("belief")[k]).alias(f"b{k}") for k in range(K)])


@query("loopy_beliefs_whole_map", beliefs_sql(links="c_sym_loose") + PER_NODE)
def loopy_beliefs_whole_map(spark, d):
    out = mrf.loopy_beliefs(whole_map(spark, d), unary(spark, d), POTENTIAL)
    return out.select("idx", *[r(F.col("belief")[k]).alias(f"b{k}") for k in range(K)])


# --- fitted models -------------------------------------------------------------------------------


def features(spark, d):
    wide = valid_bins(spark, d).select("idx", "chrom", "pos", *[F.asinh(t).alias(t) for t in TRACKS])
    return materialize(feature_arrays(wide, TRACKS, ["idx", "chrom", "pos"]))


def bin_graph(feats):
    """Edges between neighbouring valid bins, both directions."""
    near = an.chain_edges(feats).select("id1", "id2", F.lit(1.0).alias("weight"))
    return materialize(ct.swap_union(near))


@query("gaussian_mixture")
def gaussian_mixture(spark, d):
    f = features(spark, d)
    model, _ = mixture.fit_mixture(f, 4)
    return mixture.posterior(model, f).select("idx", F.transform("post", lambda x: F.round(x, 4)).alias("post"))


@query("mixture_with_propagation")
def mixture_with_propagation(spark, d):
    f = features(spark, d)
    out = mixture.mixture_with_propagation(f, bin_graph(f), 3)
    return out.select("idx", "label")


@query("random_field")
def random_field(spark, d):
    with shuffles_dropped(spark):
        f = features(spark, d)
        return mrf.fit_random_field(f, bin_graph(f), k=3)


# One step of the random field's EM from given Gaussians (unit covariance) and labels.
MEANS = [[0.5 * k + 0.1 * t for t in range(len(TRACKS))] for k in range(K)]
FIELD = f"""fx as materialized (select idx, chrom, pos, {", ".join(f"asinh({t}) x{i}" for i, t in enumerate(TRACKS))} from c_valid),
    lk as materialized (select a.idx id1, b.idx id2 from fx a join fx b on a.chrom=b.chrom and abs(a.pos-b.pos)=1),
    cells as (select p.l a, q.l b, coalesce(n, 0)+1e-100 n from (select unnest(range({K})) l) p cross join (select unnest(range({K})) l) q
      left join (select id1%{K} l1, id2%{K} l2, count(*)::double n from lk group by 1,2) c on c.l1=p.l and c.l2=q.l),
    """
FIELD_PHI = " union all ".join(
    f"select idx, {k} k, -0.5*({len(TRACKS)}*ln(2*pi())+" + "+".join(f"(x{i}-{m!r})*(x{i}-{m!r})" for i, m in enumerate(means)) + ") f from fx"
    for k, means in enumerate(MEANS)
)


@query(
    "random_field_step",
    beliefs_sql(100, links="lk", psi="select a, b, ln(n)-ln(sum(n) over ()) w from cells", phi=FIELD_PHI, head=FIELD)
    + f""", lab as (select idx, k from (select idx, k, row_number() over (partition by idx order by b desc, k) i from b) where i=1),
    sc as (select phi.idx, phi.k, any_value(phi.f)+coalesce(sum(psi.w),0) v from phi left join lk on lk.id1=phi.idx
      left join lab on lab.idx=lk.id2 left join psi on psi.a=lab.k and psi.b=phi.k group by phi.idx, phi.k),
    nm as (select k, any_value(t)+ln(sum(exp(v-t))) z from (select *, max(v) over (partition by k) t from sc) group by k)
    select idx, cast(k as bigint) label from (select sc.idx, sc.k, row_number() over (partition by idx order by v-z desc, sc.k) i from sc join nm using (k)) where i=1""",
)
def random_field_step(spark, d):
    with shuffles_dropped(spark):
        f = features(spark, d)
        links = bin_graph(f)
    params = [(np.array(m), np.eye(len(m))) for m in MEANS]
    start = f.select("idx", (F.col("idx") % K).alias("label"))
    return mrf.fit_random_field(f, links, k=K, em_iter=1, params=params, labels=start)


@query("hidden_markov_segments")
def hidden_markov_segments(spark, d):
    return label_bins(features(spark, d), 4)
