"""Bootstrap and permutation queries; the draws are integer arithmetic both sides share."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.catalog.base import rounded
from loopweave.catalog.domain import PHASES, RES, arm_sizes, dump, genes, regions, replication
from loopweave.catalog.registry import cte, query
from loopweave.catalog.scores import SHIFTS, known_labels, node_labels
from loopweave.operators import evaluation as ev
from loopweave.operators import resample as rs
from loopweave.session import materialize

REPS = 20


def draw(i, rep, n):
    mixed = (i % 1000003) * 2654435 + rep * 40503 + (i % 7919) * (i % 7919) * 104729
    return (mixed + F.floor(i / 13)) % n


DRAW = "((i%1000003)*2654435 + rep*40503 + (i%7919)*(i%7919)*104729 + i//13) % n"

cte(
    "c_gboot",
    f"""with g as (select row_number() over (order by gene_id)-1 i, asinh(expr) x, label, count(*) over () n from c_gexpr),
    f as (select *, avg(x) over (partition by label) pred from g),
    b as (select f.i, f.n, f.pred, unnest(range(0,{REPS})) rep from f),
    q as (select rep, b.pred + (s.x-s.pred) y, (s.x-s.pred) dd from (select *, {DRAW} j from b) b join f s on s.i=b.j)
    select rep::bigint rep, 1-sum(dd*dd)/(count(*)*var_pop(y)) ve from q group by rep""",
)


def gene_bootstrap(spark, d, labels):
    labelled = ev.gene_labels(genes(spark, d), labels, RES)
    rows = labelled.withColumn("signal", F.asinh("expr"))
    return rs.bootstrap_variance_explained(rows, ["gene_id"], ["signal"], REPS, draw)


@query("bootstrap_expression_ve", "select rep, round(ve,6)+0.0 ve from c_gboot")
def bootstrap_expression_ve(spark, d):
    return rounded(gene_bootstrap(spark, d, known_labels(spark, d)), "ve")


_res = ", ".join(f"{p}-avg({p}) over (partition by label) d{p}, avg({p}) over (partition by label) m{p}" for p in PHASES)
_ve = "+".join(f"(1-sum(s.d{p}*s.d{p})/(count(*)*var_pop(b.m{p}+s.d{p})))" for p in PHASES)
cte(
    "c_tboot",
    f"""with f as (select row_number() over (order by chrom,bin)-1 i, count(*) over () n, {_res} from c_rtbin),
    b as (select *, unnest(range(0,{REPS})) rep from f)
    select rep::bigint rep, ({_ve})/6 ve from (select *, {DRAW} j from b) b join f s on s.i=b.j group by rep""",
)


def timing_bootstrap(spark, d, labels):
    by_bin = ev.timing_by_bin(replication(spark, d), labels, RES, PHASES)
    return rs.bootstrap_variance_explained(by_bin, ["chrom", "bin"], PHASES, REPS, draw)


@query("bootstrap_timing_ve", "select rep, round(ve,6)+0.0 ve from c_tboot")
def bootstrap_timing_ve(spark, d):
    return rounded(timing_bootstrap(spark, d, known_labels(spark, d)), "ve")


def over_expected_sql(where: str) -> str:
    return f"""with r as (select row_number() over (order by chrom1,pos1,chrom2,pos2)-1 i, count(*) over () n, * from c_clabel where {where}),
    b as (select i, n, unnest(range(0,{REPS})) rep from r),
    t as (select rep, s.label1, s.label2, sum(s.weight) w from (select *, {DRAW} j from b) b join r s on s.i=b.j group by 1,2,3),
    c as (select label, count(*)/(select count(*) from c_nlabel) c from c_nlabel group by label),
    e as (select rep, sum(c*c) e from (select rep, label1 label from t intersect select rep, label2 from t) x join c using (label) group by rep)
    select t.rep::bigint rep, sum(case when label1=label2 then w else 0 end)/sum(w)/any_value(e) oe from t join e using (rep) group by t.rep"""


cte("c_oboot1", over_expected_sql("chrom1=chrom2"))
cte("c_oboot2", over_expected_sql("chrom1<>chrom2"))


def drawn_contacts(spark, d):
    """The contacts with both labels, stored: a filter on chromosomes would else sink below the sums into
    the scan, where it computes both ends of every line several times over.
    """
    labelled = ev.binned_pair_labels(dump(spark, d), node_labels(spark, d))
    return materialize(labelled.filter("label1 is not null and label2 is not null"))


def contact_bootstrap(contacts, shares, where):
    return rs.bootstrap_over_expected(contacts.filter(where), shares, ["chrom1", "pos1", "chrom2", "pos2"], REPS, draw)


@query("bootstrap_over_expected", "select rep, round(oe,6)+0.0 oe from c_oboot2")
def bootstrap_over_expected(spark, d):
    shares = ev.label_shares(node_labels(spark, d))
    return rounded(contact_bootstrap(drawn_contacts(spark, d), shares, "chrom1 <> chrom2"), "oe")


@query(
    "bootstrap_stats",
    """select rep, round(g.ve,6)+0.0 ge_ve, round(t.ve,6)+0.0 rt_ve, round(a.oe,6)+0.0 near_oe, round(b.oe,6)+0.0 far_oe
    from c_gboot g join c_tboot t using (rep) join c_oboot1 a using (rep) join c_oboot2 b using (rep)""",
)
def bootstrap_stats(spark, d):
    labels, contacts = materialize(known_labels(spark, d)), drawn_contacts(spark, d)
    shares = materialize(ev.label_shares(node_labels(spark, d)))
    out = rs.bootstrap_stats(
        {
            "ge_ve": gene_bootstrap(spark, d, labels),
            "rt_ve": timing_bootstrap(spark, d, labels),
            "near_oe": contact_bootstrap(contacts, shares, "chrom1 = chrom2"),
            "far_oe": contact_bootstrap(contacts, shares, "chrom1 <> chrom2"),
        }
    )
    return rounded(out, "ge_ve", "rt_ve", "near_oe", "far_oe")


@query(
    "normalized_agreement",
    """select round((select agreement from c_agreement)/(select avg(agreement) from c_agreements),4)+0.0 normalized""",
)
def normalized_agreement(spark, d):
    out = rs.normalized_agreement(
        regions(spark, d), known_labels(spark, d), arm_sizes(spark, d), RES, SHIFTS, compound=False
    )
    return rounded(out, "normalized", digits=4)


@query(
    "normalized_agreement_compound",
    """select round((select agreement from c_agreement)/(select avg(agreement) from c_agreements_compound),4)+0.0 normalized""",
)
def normalized_agreement_compound(spark, d):
    out = rs.normalized_agreement(regions(spark, d), known_labels(spark, d), arm_sizes(spark, d), RES, SHIFTS)
    return rounded(out, "normalized", digits=4)
