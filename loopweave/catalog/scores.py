"""Evaluation queries: scores of one annotation, of two, of labels against contacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.catalog.base import longs, r, rounded
from loopweave.catalog.domain import (
    PHASES,
    RES,
    arm_sizes,
    binned,
    dump,
    edges,
    genes,
    labels,
    labels2,
    nodes,
    pairs,
    regions,
    replication,
    segments,
    table,
)
from loopweave.catalog.registry import cte, query
from loopweave.operators import annotation as an
from loopweave.operators import evaluation as ev
from loopweave.operators import report
from loopweave.operators.contacts import both_directions

cte("c_cov", "select label, sum(en-st)/(select sum(en-st) from c_seg) coverage from c_seg group by label")


@query("coverage", "select label, round(coverage,6)+0.0 coverage from c_cov")
def coverage(spark, d):
    return rounded(ev.coverage(segments(spark, d)), "coverage")


@query("label_shares", "select label, round(count(*)/(select count(*) from c_label),6)+0.0 coverage from c_label group by label")
def label_shares(spark, d):
    return rounded(ev.label_shares(labels(spark, d)), "coverage")


@query("coverage_entropy", "select round(-sum(coverage*ln(coverage)),6)+0.0 entropy from c_cov")
def coverage_entropy(spark, d):
    return rounded(ev.entropy(ev.coverage(segments(spark, d))), "entropy")


@query("segment_lengths", "select label, round((en-st)/1e6,6)+0.0 length_mb from c_seg")
def segment_lengths(spark, d):
    return rounded(ev.segment_lengths(segments(spark, d)), "length_mb")


@query(
    "enrichment",
    """with j as (select b.track, b.signal, l.label from c_binned b left join c_label2 l on l.chrom=b.chrom and l.pos=b.bin and l.label<>'view'),
    g as (select track, avg(signal) m from j group by track)
    select j.track, j.label, round(avg(signal)/any_value(m),2)+0.0 enrichment from j join g using (track)
    where label is not null group by j.track, j.label""",
)
def enrichment(spark, d):
    known = labels2(spark, d).filter("label <> 'view'")
    values = binned(spark, d).join(known, ["chrom", "pos"], "left")
    return ev.enrichment(values)


cte("c_sigl", "select b.track, b.signal x, l.label from c_binned b join c_label2 l on l.chrom=b.chrom and l.pos=b.bin")


@query(
    "variance_explained",
    """with m as (select *, avg(x) over (partition by track,label) ml, avg(x) over (partition by track) mg from c_sigl)
    select track, round(1-sum((x-ml)*(x-ml))/sum((x-mg)*(x-mg)),6)+0.0 ve from m group by track""",
)
def variance_explained(spark, d):
    rows = binned(spark, d).join(labels2(spark, d), ["chrom", "pos"]).withColumnRenamed("value", "signal")
    return rounded(ev.variance_explained(rows, by=["track"]), "ve")


@query(
    "variance_explained_segments",
    """with j as (select x, label from c_sigl where track='click'),
    m as (select *, avg(x) over (partition by label) ml, avg(x) over () mg from j)
    select round(1-sum((x-ml)*(x-ml))/sum((x-mg)*(x-mg)),6)+0.0 ve from m""",
)
def variance_explained_segments(spark, d):
    melted = an.melt(an.segments(labels2(spark, d), RES), RES)
    signal = binned(spark, d).filter("track = 'click'").withColumnRenamed("value", "signal")
    return rounded(ev.variance_explained(melted.join(signal, ["chrom", "pos"])), "ve")


@query(
    "within_cluster_squares",
    """with l as (select vec_id, label, generate_subscripts(embedding,1) k, unnest(embedding)::double x from embeddings),
    m as (select *, avg(x) over (partition by label,k) mu from l)
    select round(sum((x-mu)*(x-mu)),4)+0.0 sse from m""",
)
def within_cluster_squares(spark, d):
    e = table(spark, d, "embeddings").select("label", F.expr("transform(embedding, x -> cast(x as double))").alias("features"))
    return rounded(ev.within_cluster_squares(e), "sse", digits=4)


@query(
    "cluster_spread_scores",
    """with l as (select vec_id, label, generate_subscripts(embedding,1) k, unnest(embedding)::double x from embeddings),
    m as (select label, k, avg(x) mu, count(*) n from l group by label,k),
    g as (select k, avg(x) mg from l group by k),
    dd as (select vec_id, l.label, sum((x-mu)*(x-mu)) sq from l join m on m.label=l.label and m.k=l.k group by vec_id,l.label),
    s as (select label, avg(sqrt(sq)) s, sum(sq) sse, count(*) n from dd group by label),
    b as (select sum(n*(mu-mg)*(mu-mg)) ssb from m join g using (k)),
    z as (select a.label la, b.label lb, sqrt(sum((a.mu-b.mu)*(a.mu-b.mu))) dist from m a join m b on a.k=b.k and a.label<>b.label group by 1,2),
    q as (select la, max((x.s+y.s)/dist) r from z join s x on x.label=la join s y on y.label=lb group by la)
    select round(((select ssb from b)/((select count(*) from s)-1))/((select sum(sse) from s)/((select sum(n) from s)-(select count(*) from s))),6)+0.0 ch,
    round((select avg(r) from q),6)+0.0 db""",
)
def cluster_spread_scores(spark, d):
    e = table(spark, d, "embeddings").select("label", F.expr("transform(embedding, x -> cast(x as double))").alias("features"))
    return rounded(ev.cluster_spread_scores(e), "ch", "db")


# --- regions and genes ----------------------------------------------------------------------

cte(
    "c_gbins",
    """select gene_id, label, sum(ov) w, min(bin) f from (
    select g.*, least(en,(bin+1)*3600)-greatest(st,bin*3600) ov from (
      select *, unnest(range(st//3600,(en-1)//3600+1)) bin from c_genes) g) x
    left join c_label2 l on l.chrom=x.chrom and l.pos=x.bin and l.label<>'view' group by gene_id, label""",
)
cte(
    "c_glabel",
    """select gene_id, label from (select *, row_number() over (partition by gene_id order by w desc, f) rn from c_gbins) where rn=1""",
)


def known_labels(spark, d):
    """An annotation with unlabelled bins among the labelled ones."""
    return labels2(spark, d).filter("label <> 'view'")


@query("region_labels", "select gene_id, coalesce(label,'none') as label from c_glabel")
def region_labels(spark, d):
    g = genes(spark, d).withColumnRenamed("gene_id", "region_id")
    found = an.region_label(g, known_labels(spark, d), RES)
    return found.select(F.col("region_id").alias("gene_id"), F.coalesce("label", F.lit("none")).alias("label"))


@query("region_label_weights", "select gene_id, coalesce(label,'none') as label, w::bigint weight from c_gbins")
def region_label_weights(spark, d):
    g = genes(spark, d).withColumnRenamed("gene_id", "region_id")
    w = an.region_weights(g, known_labels(spark, d), RES)
    return longs(w.select(F.col("region_id").alias("gene_id"), F.coalesce("label", F.lit("none")).alias("label"), "weight"), "weight")


cte("c_gexpr", "select gene_id, expr, label from c_glabel join c_genes using (gene_id) where label is not null")


@query("gene_expression_classes", "select gene_id, expr, label from c_gexpr")
def gene_expression_classes(spark, d):
    return ev.gene_labels(genes(spark, d), known_labels(spark, d), RES)


@query("gene_expression_by_label", "select label, round(avg(expr),6)+0.0 expr from c_gexpr group by label")
def gene_expression_by_label(spark, d):
    labelled = ev.gene_labels(genes(spark, d), known_labels(spark, d), RES)
    return rounded(ev.expression_by_label(labelled), "expr")


@query(
    "genes_per_label",
    """with c as (select label, count(*) n from c_gexpr group by label)
    select label, round(n/((select n from c where label=(select min(label) from c))/10),6)+0.0 genes from c""",
)
def genes_per_label(spark, d):
    labelled = ev.gene_labels(genes(spark, d), known_labels(spark, d), RES)
    return rounded(ev.genes_per_label(labelled, reference_label="click"), "genes")


@query("genes_per_own_label", "select label, 10.0::double genes from c_gexpr group by label")
def genes_per_own_label(spark, d):
    labelled = ev.gene_labels(genes(spark, d), known_labels(spark, d), RES)
    return rounded(ev.genes_per_label(labelled), "genes")


cte(
    "c_geve",
    """select 1-sum((x-ml)*(x-ml))/sum((x-mg)*(x-mg)) ve from (
    select *, avg(x) over (partition by label) ml, avg(x) over () mg from (select asinh(expr) x, label from c_gexpr))""",
)


@query("gene_expression_ve", "select round(ve,6)+0.0 ve from c_geve")
def gene_expression_ve(spark, d):
    return rounded(ev.expression_ve(genes(spark, d), known_labels(spark, d), RES), "ve")


cte("c_known", "select * from c_label2 where label<>'view'")
cte(
    "c_kseg",
    """
select chrom, min(pos)*3600 st, (max(pos)+1)*3600 en, min(label) as label from (
  select *, sum(s) over (partition by chrom order by pos rows unbounded preceding) seg from (
    select *, case when lag(label) over w = label and lag(pos) over w = pos-1 then 0 else 1 end s
    from c_known window w as (partition by chrom order by pos)))
group by chrom, seg""",
)

REGION_ARMS = """with rb as (select region_id, chrom, bin, least(en,(bin+1)*3600)-greatest(st,bin*3600) ov, greatest(st,bin*3600) at0 from (
      select *, unnest(range(st//3600,(en-1)//3600+1)) bin from c_regions)),
    ra as (select rb.*, case when at0<size then 'p' else 'q' end arm,
      case when at0<size then at0//3600 when at0//3600>=(size+3599)//3600 then at0//3600-(size+3599)//3600 end ap
      from rb join c_arms a on a.chrom=rb.chrom and a.arm='p'),
    w as (select {rep} region_id, label, sum(ov) w, min(bin) f from {src} group by {rep} region_id, label),
    k as (select *, row_number() over (partition by {rep} region_id order by w desc, f) rn, sum(w) over (partition by {rep} region_id) tot,
      sum(case when label is not null then w end) over (partition by {rep} region_id) lb from w)
    select {rep} avg(w/tot) agreement from k where rn=1 and label is not null and lb/3600>3 {grp}"""


cte(
    "c_arm_known",
    """select * from (select chrom, 'p' arm, pos arm_pos, label from c_known join c_arms using (chrom) where arm='p' and pos*3600 < size
    union all select chrom, 'q', pos - (size+3599)//3600, label from c_known join c_arms using (chrom)
    where arm='p' and pos*3600 >= size) where arm_pos>=0""",
)


cte(
    "c_agreement",
    REGION_ARMS.format(
        rep="", grp="",
        src="ra left join c_arm_known l on l.chrom=ra.chrom and l.arm=ra.arm and l.arm_pos=ra.ap",
    ),
)


@query("region_agreement", "select round(agreement,6)+0.0 agreement from c_agreement")
def region_agreement(spark, d):
    arms = arm_sizes(spark, d)
    by_arm = an.arm_labels(known_labels(spark, d), arms, RES)
    return rounded(ev.region_agreement(regions(spark, d), by_arm, arms, RES), "agreement")


SHIFTS = [0.137, 0.5, 0.829]
cte(
    "c_known_shifted",
    """select rep::bigint rep, chrom, arm, (arm_pos + floor(len*r)::bigint) % len arm_pos, label from (
      select l.*, (a.size+3599)//3600 len from c_arm_known l join c_arms a using (chrom, arm))
    join (values """
    + ",".join(f"({i},{s}::double)" for i, s in enumerate(SHIFTS))
    + ") f(rep,r) on true where arm_pos < len",
)
cte(
    "c_agreements",
    REGION_ARMS.format(
        rep="rep,", grp="group by rep",
        src="""(select ra.*, unnest([0,1,2])::bigint rep from ra) ra left join
        (select rep rp, chrom, arm, arm_pos, label from c_known_shifted) l
        on l.rp=ra.rep and l.chrom=ra.chrom and l.arm=ra.arm and l.arm_pos=ra.ap""",
    ),
)


# Every shift on top of the ones before it, as the operator's default does.
TOTALS = [" + ".join(f"floor(len*{s}::double)::bigint" for s in SHIFTS[: i + 1]) for i in range(len(SHIFTS))]
cte(
    "c_known_compound",
    "select rep, chrom, arm, (arm_pos + shift) % len arm_pos, label from (select *, unnest([0,1,2])::bigint rep, unnest(["
    + ", ".join(TOTALS)
    + "]) shift from (select l.*, (a.size+3599)//3600 len from c_arm_known l join c_arms a using (chrom, arm)) where arm_pos < len)",
)
cte(
    "c_agreements_compound",
    REGION_ARMS.format(
        rep="rep,", grp="group by rep",
        src="""(select ra.*, unnest([0,1,2])::bigint rep from ra) ra left join
        (select rep rp, chrom, arm, arm_pos, label from c_known_compound) l
        on l.rp=ra.rep and l.chrom=ra.chrom and l.arm=ra.arm and l.arm_pos=ra.ap""",
    ),
)


@query("region_agreement_shifted", "select rep, round(agreement,6)+0.0 agreement from c_agreements")
def region_agreement_shifted(spark, d):
    arms = arm_sizes(spark, d)
    by_arm = an.arm_labels(known_labels(spark, d), arms, RES)
    shifted = an.shift_arm_labels(by_arm, arms, RES, SHIFTS)
    out = ev.region_agreement(regions(spark, d), shifted, arms, RES, reps=["rep"], versions=[0, 1, 2])
    return rounded(longs(out, "rep"), "agreement")


# --- replication timing ----------------------------------------------------------------------

cte(
    "c_rtl",
    "select t.*, l.label from c_rt t left join c_label2 l on l.chrom=t.chrom and l.pos=t.pos//3600 and l.label<>'view'",
)
cte(
    "c_rtbin",
    "select chrom, pos//3600 bin, max(label) as label, "
    + ", ".join(f"avg({p}) {p}" for p in PHASES)
    + " from c_rtl group by chrom, pos//3600 having max(label) is not null",
)


@query(
    "timing_by_bin",
    "select chrom, bin, label, " + ", ".join(f"round({p},6)+0.0 {p}" for p in PHASES) + " from c_rtbin",
)
def timing_by_bin(spark, d):
    return rounded(ev.timing_by_bin(replication(spark, d), known_labels(spark, d), RES, PHASES), *PHASES)


def phase_ve(source: str) -> str:
    cols = ", ".join(
        f"1-sum(({p}-l{p})*({p}-l{p}))/sum(({p}-g{p})*({p}-g{p})) v{p}" for p in PHASES
    )
    means = ", ".join(
        f"avg({p}) over (partition by label) l{p}, avg({p}) over () g{p}" for p in PHASES
    )
    total = "+".join(f"v{p}" for p in PHASES)
    return f"select ({total})/6 ve from (select {cols} from (select *, {means} from {source} where label is not null))"


cte("c_rtve", phase_ve("c_rtbin"))
cte("c_rtve_point", phase_ve("c_rtl"))
cte(
    "c_rtari",
    "with t as (select case "
    + " ".join(f"when {p}=greatest({','.join(PHASES)}) then {i}" for i, p in enumerate(PHASES))
    + """ end a, label b from c_rtl where label is not null), n as (select a,b,count(*) n from t group by a,b),
    s as (select (select sum(n*(n-1)/2) from n) c, (select sum(x*(x-1)/2) from (select sum(n) x from n group by a)) r,
    (select sum(x*(x-1)/2) from (select sum(n) x from n group by b)) k, (select sum(n)*(sum(n)-1)/2 from n) m)
    select (c-r*k/m)/((r+k)/2-r*k/m) ari from s""",
)


@query("timing_ve", "select round(ve,6)+0.0 ve from c_rtve")
def timing_ve(spark, d):
    by_bin = ev.timing_by_bin(replication(spark, d), known_labels(spark, d), RES, PHASES)
    return rounded(ev.mean_phase_ve(by_bin, PHASES), "ve")


@query(
    "timing_scores",
    "select round(ve,6)+0.0 ve, round((select ari from c_rtari),6)+0.0 ari from c_rtve_point",
)
def timing_scores(spark, d):
    return rounded(ev.timing_scores(replication(spark, d), known_labels(spark, d), RES, PHASES), "ve", "ari")


# --- labels of contacts ------------------------------------------------------------------------

SIDE = """select chrom,st,en,label from (select *, row_number() over (partition by chrom,st,en order by w desc,f) rn from (
      select chrom, st, en, label, sum(ov) w, min(bin) f from (
        select r.*, l.label, least(en,(bin+1)*3600)-greatest(st,bin*3600) ov from (
          select *, unnest(range(st//3600,(en-1)//3600+1)) bin from ({src})) r
        left join c_label2 l on l.chrom=r.chrom and l.pos=r.bin and l.label<>'view')
      group by chrom,st,en,label)) where rn=1"""
cte("c_side1", SIDE.format(src="select distinct chrom1 chrom, st1 st, en1 en from c_pairs"))
cte("c_side2", SIDE.format(src="select distinct chrom2 chrom, st2 st, en2 en from c_pairs"))
cte(
    "c_plabel",
    """select a.label label1, b.label label2, p.weight, p.chrom1, p.chrom2 from c_pairs p
    join c_side1 a on a.chrom=p.chrom1 and a.st=p.st1 and a.en=p.en1
    join c_side2 b on b.chrom=p.chrom2 and b.st=p.st2 and b.en=p.en2""",
)
cte(
    "c_ptable",
    "select label1, label2, sum(weight)::bigint n from c_plabel where label1 is not null and label2 is not null group by 1,2",
)
cte(
    "c_kcov",
    "select label, count(*)/(select count(*) from c_label2 where label<>'view') coverage from c_label2 where label<>'view' group by label",
)


def pair_table(spark, d):
    return longs(ev.contingency(ev.paired_labels(pairs(spark, d), known_labels(spark, d), RES), "weight"), "n")


@query("paired_region_table", "select label1,label2,n from c_ptable")
def paired_region_table(spark, d):
    return pair_table(spark, d)


@query(
    "paired_region_pivot",
    "select label1, "
    + ", ".join(f"coalesce(sum(case when label2='{t}' then n end),0)::bigint {t}" for t in ["click", "error", "purchase", "signup"])
    + " from c_ptable group by label1",
)
def paired_region_pivot(spark, d):
    names = ["click", "error", "purchase", "signup"]
    return pair_table(spark, d).groupBy("label1").pivot("label2", names).agg(F.sum("n")).na.fill(0)


@query("diagonal_share", "select round(sum(case when label1=label2 then n else 0 end)/sum(n),6)+0.0 ratio from c_ptable")
def diagonal_share(spark, d):
    return rounded(ev.diagonal_share(pair_table(spark, d)), "ratio")


cte(
    "c_poe",
    """select (select sum(case when label1=label2 then n else 0 end)/sum(n) from c_ptable)
    /(select sum(coverage*coverage) from c_kcov) oe""",
)


@query("intra_over_expected", "select round(oe,6)+0.0 oe from c_poe")
def intra_over_expected(spark, d):
    return rounded(ev.intra_over_expected(pair_table(spark, d), ev.label_shares(known_labels(spark, d))), "oe")


# contact-map bins labelled by a per-bin annotation of the nodes
cte("c_nlabel", "select chrom, pos, 'L'||((idx//7)%5) as label from c_nodes")
cte(
    "c_clabel",
    """select a.label label1, b.label label2, weight, chrom1,pos1,chrom2,pos2 from c_dump
    join c_nlabel a on a.chrom=chrom1 and a.pos=pos1 join c_nlabel b on b.chrom=chrom2 and b.pos=pos2""",
)


def node_labels(spark, d):
    return nodes(spark, d).select(
        "chrom", "pos", F.concat(F.lit("L"), (F.floor(F.col("idx") / 7) % 5).cast("string")).alias("label")
    )


def labelled_contacts(spark, d):
    return ev.binned_pair_labels(dump(spark, d), node_labels(spark, d)).filter(
        "label1 is not null and label2 is not null"
    )


@query("binned_pair_table", "select label1,label2,sum(weight) n from c_clabel group by 1,2")
def binned_pair_table(spark, d):
    return ev.contingency(labelled_contacts(spark, d), "weight")


@query(
    "binned_over_expected",
    """select round((select sum(case when label1=label2 then weight else 0 end)/sum(weight) from c_clabel)
    /(select sum(c*c) from (select count(*)/(select count(*) from c_nlabel) c from c_nlabel group by label)),6)+0.0 oe""",
)
def binned_over_expected(spark, d):
    t = ev.contingency(labelled_contacts(spark, d), "weight")
    return rounded(ev.intra_over_expected(t, ev.label_shares(node_labels(spark, d))), "oe")


@query(
    "point_over_expected",
    """with t as (select label1,label2,count(*) n from c_clabel where label1<>'L3' and label2<>'L1' group by 1,2),
    c as (select label, count(*)/(select count(*) from c_nlabel) c from c_nlabel group by label)
    select round((select sum(case when label1=label2 then n else 0 end)/sum(n) from t)
    /(select sum(c*c) from c where label in (select label1 from t) and label in (select label2 from t)),6)+0.0 oe""",
)
def point_over_expected(spark, d):
    kept = labelled_contacts(spark, d).filter("label1 <> 'L3' and label2 <> 'L1'")
    return rounded(
        ev.intra_over_expected(ev.contingency(kept), ev.label_shares(node_labels(spark, d)), on_both_axes=True), "oe"
    )


SYM = """with t as (select label1,label2,sum(weight) n from c_clabel where label1<>'L3' group by 1,2),
    l as (select label1 x from t union select label2 from t),
    s as (select a.x label1, b.x label2, coalesce(sum(t.n),0) n from l a join l b on true
      left join t on (t.label1=a.x and t.label2=b.x) or (a.x<>b.x and t.label1=b.x and t.label2=a.x) group by 1,2)"""


@query("symmetric_table", SYM + " select label1,label2,n from s")
def symmetric_table(spark, d):
    t = ev.contingency(labelled_contacts(spark, d).filter("label1 <> 'L3'"), "weight")
    return ev.symmetric_table(t)


@query(
    "table_over_expected",
    SYM + """, c as (select label, count(*)/(select count(*) from c_nlabel) c from c_nlabel group by label)
    select label1,label2,round(n/((select sum(n) from s)*a.c*b.c),2)+0.0 oe from s
    join c a on a.label=label1 join c b on b.label=label2""",
)
def table_over_expected(spark, d):
    t = ev.symmetric_table(ev.contingency(labelled_contacts(spark, d).filter("label1 <> 'L3'"), "weight"))
    shares = ev.label_shares(node_labels(spark, d))
    return ev.over_expected(t, shares, shares)


# --- two annotations -----------------------------------------------------------------------------

cte("c_two", "select a.label label1, b.label label2, count(*)::bigint n from c_label a join c_label2 b using (chrom,pos) group by 1,2")


def two(spark, d):
    first = labels(spark, d).withColumnRenamed("label", "label1")
    return ev.contingency(first.join(labels2(spark, d).withColumnRenamed("label", "label2"), ["chrom", "pos"]))


@query("overlap_counts", "select label1,label2,n from c_two")
def overlap_counts(spark, d):
    return two(spark, d)


@query("overlap_share", "select label1,label2,round(n/sum(n) over (partition by label1),6)+0.0 \"share\" from c_two")
def overlap_share(spark, d):
    return rounded(ev.column_shares(two(spark, d)), "share")


@query(
    "overlap_enrichment",
    """with m as (select label1,label2,n,sum(n) over ()::bigint total, sum(n) over (partition by label1)/sum(n) over ()
      *sum(n) over (partition by label2)/sum(n) over () p from c_two)
    select label1,label2,n,round(n/(total*p),6)+0.0 oe,
    round(case when n=0 then 1.0 else (select sum(exp(lgamma(total+1)-lgamma(i+1)-lgamma(total-i+1)+i*ln(p)+(total-i)*ln(1-p)))
      from (select unnest(range(n,total+1)) i)) end,6)+0.0 pvalue from m""",
)
def overlap_enrichment(spark, d):
    out = ev.overlap_enrichment(two(spark, d))
    return rounded(out.select("label1", "label2", "n", "oe", "pvalue"), "oe", "pvalue")


@query(
    "adjusted_rand",
    """with s as (select (select sum(n*(n-1)/2) from c_two) c, (select sum(x*(x-1)/2) from (select sum(n) x from c_two group by label1)) r,
    (select sum(x*(x-1)/2) from (select sum(n) x from c_two group by label2)) k, (select sum(n)*(sum(n)-1)/2 from c_two) m)
    select round((c-r*k/m)/((r+k)/2-r*k/m),6)+0.0 ari from s""",
)
def adjusted_rand(spark, d):
    first = labels(spark, d).withColumnRenamed("label", "label1")
    return rounded(ev.adjusted_rand(first.join(labels2(spark, d).withColumnRenamed("label", "label2"), ["chrom", "pos"])), "ari")


MORAN = """with e as (select id1,id2,sum(weight) w from (select id1,id2,weight from c_edges where id1<>id2 union all select id2,id1,weight from c_edges where id1<>id2) group by 1,2),
    v as (select idx, price - (select avg(price) from c_nodes) d from c_nodes),
    n as (select count(*)::double n, sum(d*d) m2, sum(d*d*d*d) m4 from v),
    c as (select sum(w*a.d*b.d) c from e join v a on a.idx=id1 join v b on b.idx=id2),
    t as (select sum(w) w from e),
    s1 as (select sum((e.w+coalesce(f.w,0))*(e.w+coalesce(f.w,0)))/2 s1 from e left join e f on f.id1=e.id2 and f.id2=e.id1),
    s2 as (select sum(m*m) s2 from (select i,sum(w) m from (select id1 i,w from e union all select id2,w from e) group by i)),
    q as (select n, c, w, m2, s1, s2, (m4/n)/((m2/n)*(m2/n)) s3 from n,c,t,s1,s2),
    z as (select n*c/(w*m2) moran, -1/(n-1) expected,
      (n*((n*n-3*n+3)*s1-n*s2+3*w*w)-s3*((n*n-n)*s1-2*n*s2+6*w*w))/((n-1)*(n-2)*(n-3)*w*w)-1/((n-1)*(n-1)) variance from q)"""


# Upper tail of the normal distribution; fixed values of Abramowitz and Stegun 26.2.17 (error below 1e-7).
TAIL = "exp(-z*z/2)/sqrt(2*pi())*t*(0.319381530+t*(-0.356563782+t*(1.781477937+t*(-1.821255978+t*1.330274429))))"


@query(
    "morans_i",
    MORAN + f""", zs as (select *, (moran-expected)/sqrt(variance) z_score from z),
    tails as (select *, {TAIL} tail from (select *, 1/(1+0.2316419*z) t from (select *, abs(z_score) z from zs)))
    select round(moran,6)+0.0 moran, round(expected,6)+0.0 expected, round(variance,8)+0.0 variance,
    round(z_score,6)+0.0 z_score, round(case when z_score<0 then 1-tail else tail end,4)+0.0 p_value from tails""",
)
def morans_i(spark, d):
    values = nodes(spark, d).select("idx", F.col("price").alias("value"))
    out = ev.morans_i(values, both_directions(edges(spark, d)))
    return rounded(rounded(rounded(out, "moran", "expected", "z_score"), "variance", digits=8), "p_value", digits=4)


cte(
    "c_brief",
    """select round((select avg(en-st) from c_kseg),6)+0.0 avg_length, (select count(*) from c_kseg) num_domains,
    round((select ve from c_geve),6)+0.0 ge_ve, round((select ve from c_rtve_point),6)+0.0 rt_score1,
    round((select ari from c_rtari),6)+0.0 rt_score2, round((select -sum(coverage*ln(coverage)) from c_kcov),6)+0.0 ent""",
)


@query("brief_stats", "select * from c_brief")
def brief_stats(spark, d):
    known = known_labels(spark, d)
    out = report.brief_stats(an.segments(known, RES), known, genes(spark, d), replication(spark, d), RES, PHASES)
    return rounded(longs(out, "num_domains"), "avg_length", "ge_ve", "rt_score1", "rt_score2", "ent")


OE = """round((select sum(case when label1=label2 then weight else 0 end)/sum(weight) from c_plabel
    where label1 is not null and label2 is not null and chrom1{op}chrom2)/(select sum(coverage*coverage) from c_kcov),6)+0.0 {name}"""


@query("full_stats", f"select *, {OE.format(op='=', name='near_oe')}, {OE.format(op='<>', name='far_oe')} from c_brief")
def full_stats(spark, d):
    known = known_labels(spark, d)
    all_pairs = pairs(spark, d)
    out = report.stats(
        an.segments(known, RES), known, genes(spark, d), replication(spark, d), RES, PHASES,
        {"near_oe": all_pairs.filter("chrom1 = chrom2"), "far_oe": all_pairs.filter("chrom1 <> chrom2")},
    )
    return rounded(longs(out, "num_domains"), "avg_length", "ge_ve", "rt_score1", "rt_score2", "ent", "near_oe", "far_oe")
