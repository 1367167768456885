"""Embedding, linear model and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.catalog.base import longs, r, rounded
from loopweave.catalog.domain import edges, nodes, table
from loopweave.catalog.graphs import graph
from loopweave.catalog.registry import CTES, cte, query
from loopweave.functions.scalar import vector_norm
from loopweave.operators import classify as cl
from loopweave.operators import contacts as ct
from loopweave.operators import embed as em
from loopweave.operators import dual
from loopweave.operators import linear as ln

NORM = "sqrt(list_sum([cast(x as double)*cast(x as double) for x in embedding]))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("idx"),
        F.expr("transform(embedding, x -> cast(x as double))").alias("vec"),
        F.col("label").cast("double").alias("label"),
    )


@query("vector_norms", f"select vec_id idx, round({NORM},6)+0.0 norm from embeddings")
def vector_norms(spark, d):
    return vectors(spark, d).select("idx", r(vector_norm(F.col("vec"))).alias("norm"))


@query(
    "unit_vectors",
    f"select vec_id idx, unnest(range(64))::bigint d, round(unnest([cast(x as double) for x in embedding])/{NORM},6)+0.0 x from embeddings",
)
def unit_vectors(spark, d):
    out = em.normalise(vectors(spark, d)).select("idx", F.posexplode("vec").alias("d", "x"))
    return rounded(longs(out, "d"), "x")


@query(
    "concatenated_vectors",
    f"""with v as (select vec_id idx, unnest(range(64)) d, unnest([cast(x as double) for x in embedding])/{NORM} x from embeddings)
    select idx, d::bigint d, round(x,6)+0.0 x from v union all select idx, d+64, round(x,6)+0.0 from v where idx%2=0
    union all select idx, d+64, -1.0 from v where idx%2=1""",
)
def concatenated_vectors(spark, d):
    v = vectors(spark, d)
    out = em.concatenate(v, v.filter("idx % 2 = 0")).select("idx", F.posexplode("vec").alias("d", "x"))
    return rounded(longs(out, "d").withColumn("x", F.nanvl("x", F.lit(-1.0))), "x")


@query(
    "vectors_by_position",
    """select n.idx, n.chrom, n.pos, """ + ", ".join(f"round(embedding[{i}]::double,6)+0.0 emb{i}" for i in range(1, 65)) + """
    from embeddings join c_nodes n on n.idx=vec_id""",
)
def vectors_by_position(spark, d):
    out = em.with_positions(vectors(spark, d), nodes(spark, d))
    return rounded(out, *[f"emb{i}" for i in range(1, 65)])


@query(
    "negative_cells",
    """with g as (select v, sum(w) degree from (select id1 v, weight w from c_edges union all select id2, weight from c_edges) group by v),
    w as (select v, pow(degree,0.75) w from g),
    c as (select v, 10000.0::double*w/(select sum(w) from w) t, 10000.0::double*coalesce(sum(w) over (order by v rows between unbounded preceding and 1 preceding),0)/(select sum(w) from w) b from w)
    select v idx, cast(least(ceil(b+t),10000)-ceil(b) as bigint) cells from c where least(ceil(b+t),10000)>ceil(b)""",
)
def negative_cells(spark, d):
    v = ct.degrees(edges(spark, d))
    return em.negative_cells(v, 10000).groupBy("idx").agg(F.count("*").alias("cells"))


@query("graph_embedding")
def graph_embedding(spark, d):
    return em.embed(graph(spark, d), em.EmbedParams(dim=8)).select("idx", "vec")


@query("graph_embedding_first_order")
def graph_embedding_first_order(spark, d):
    return em.embed(graph(spark, d), em.EmbedParams(dim=8, order=1)).select("idx", "vec")


@query("embedding_plane")
def embedding_plane(spark, d):
    return em.plane(vectors(spark, d).select("idx", "vec"))


# --- linear models -------------------------------------------------------------------------------


def instances(spark, d):
    return ln.sparse_rows(vectors(spark, d).withColumnRenamed("vec", "features"), keep=("idx", "label"))


@query("logistic_classes")
def logistic_classes(spark, d):
    data = instances(spark, d)
    model = ln.train(data, ln.LinearParams(solver=0), 64)
    return ln.predict(data, model).select("idx", "label", "prediction")


@query("hinge_classes")
def hinge_classes(spark, d):
    data = instances(spark, d)
    model = ln.train(data, ln.LinearParams(solver=2), 64)
    return ln.predict(data, model).select("idx", "label", "prediction")


@query("ridge_regression")
def ridge_regression(spark, d):
    data = instances(spark, d)
    model = ln.train(data, ln.LinearParams(solver=11, bias=1.0), 64)
    return ln.scores(ln.predict(data, model)).select("mse", "scc")


@query("cross_validated_classes")
def cross_validated_classes(spark, d):
    out = ln.cross_validate(instances(spark, d), "idx", ln.LinearParams(solver=0), 64, 5)
    return out.select("idx", "label", "prediction")


# --- machines trained in the dual: optimality conditions instead of values -----------------------


def dual_conditions(spark, d, solvers, data, near=0.02, **options):
    """solver, label, n, violated of every solver's fit."""
    out = None
    for solver in solvers:
        params = ln.LinearParams(solver=solver, eps=1e-5, **options)
        found = dual.violations(dual.fit_dual(data, params, 64), params, near)
        found = found.select(F.lit(solver).cast("bigint").alias("solver"), "label", "n", "violated")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "dual_machines",
    """select s solver, label::double label, count(*) n, 0::bigint violated
    from embeddings, (values (1::bigint), (3::bigint)) t(s) where label is not null group by 1, 2""",
)
def dual_machines(spark, d):
    return dual_conditions(spark, d, (1, 3), instances(spark, d))


@query(
    "dual_regression",
    """select s solver, count(*) n, 0::bigint violated
    from embeddings, (values (12::bigint), (13::bigint)) t(s) where label is not null group by 1""",
)
def dual_regression(spark, d):
    each = dual_conditions(spark, d, (12, 13), instances(spark, d))
    return each.groupBy("solver").agg(F.sum("n").alias("n"), F.sum("violated").alias("violated"))


@query(
    "joint_machine",
    "select label::double label, count(*) n, true optimal from embeddings where label is not null group by 1",
)
def joint_machine(spark, d):
    fit = dual.fit_dual(instances(spark, d), ln.LinearParams(solver=4, eps=1e-4), 64)
    reached = bool(fit.gap[0] <= 1e-4 * fit.primal[0])
    return fit.data.groupBy("label").agg(F.count("*").alias("n")).withColumn("optimal", F.lit(reached))


@query(
    "prediction_scores",
    """with s as (select (l_quantity)::double y, (l_quantity + case when l_suppkey%5=0 then l_discount*100-4 else 0 end)::double v from lineitem)
    select round(avg(case when y=v then 1.0 else 0.0 end)*100,6)+0.0 accuracy, round(avg((v-y)*(v-y)),6)+0.0 mse,
    round(pow(corr(v,y),2),6)+0.0 scc from s""",
)
def prediction_scores(spark, d):
    v = F.col("l_quantity") + F.when(F.col("l_suppkey") % 5 == 0, F.col("l_discount") * 100 - 4).otherwise(0)
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("label"), v.alias("prediction"))
    return rounded(ln.scores(rows), "accuracy", "mse", "scc")


@query(
    "problem_transpose",
    """with s as (select vec_id idx, unnest(range(64)) f, unnest(embedding)::double v from embeddings)
    select f::bigint feature, count(*)::bigint n, round(sum(v),5)+0.0 total from s where v<>0 group by f""",
)
def problem_transpose(spark, d):
    rows = instances(spark, d).select(F.explode(F.arrays_zip("index", "value")).alias("e"))
    return rounded(
        rows.groupBy(F.col("e.index").cast("bigint").alias("feature")).agg(
            F.count("*").alias("n"), F.sum("e.value").alias("total")
        ),
        "total", digits=5,
    )


# --- multi-label evaluation ------------------------------------------------------------------------

cte(
    "c_truth",
    """select doc_id idx, 'quality' as label from labels where quality=1 union all
    select doc_id, 'toxic' from labels where toxic=1 union all select doc_id, 'long' from documents where n_chars>2000""",
)
cte(
    "c_score",
    """select doc_id idx, 'quality' as label, (n_chars%101)/101.0::double score from documents union all
    select doc_id, 'toxic', ((n_chars*7+doc_id)%103)/103.0::double from documents union all
    select doc_id, 'long', n_chars/10000.0::double from documents""",
)
cte(
    "c_predicted",
    """select idx, label from (select s.*, w.n, row_number() over (partition by s.idx order by score desc, s.label) rn
    from c_score s join (select idx, count(*) n from c_truth group by idx) w using (idx)) where rn<=n""",
)


def truth(spark, d):
    lab, doc = table(spark, d, "labels"), table(spark, d, "documents")
    one = lab.filter("quality = 1").select(F.col("doc_id").alias("idx"), F.lit("quality").alias("label"))
    two = lab.filter("toxic = 1").select(F.col("doc_id").alias("idx"), F.lit("toxic").alias("label"))
    three = doc.filter("n_chars > 2000").select(F.col("doc_id").alias("idx"), F.lit("long").alias("label"))
    return one.unionByName(two).unionByName(three)


def scored(spark, d):
    n, key = F.col("n_chars"), F.col("doc_id")
    each = F.array(
        F.struct(F.lit("quality").alias("label"), (n % 101 / F.lit(101.0)).alias("score")),
        F.struct(F.lit("toxic").alias("label"), ((n * 7 + key) % 103 / F.lit(103.0)).alias("score")),
        F.struct(F.lit("long").alias("label"), (n / F.lit(10000.0)).alias("score")),
    )
    return table(spark, d, "documents").select(key.alias("idx"), F.explode(each).alias("s")).select("idx", "s.label", "s.score")


@query("predicted_labels", "select idx, label from c_predicted")
def predicted_labels(spark, d):
    return cl.predicted_labels(truth(spark, d), scored(spark, d))


cte(
    "c_f1",
    """with k as (select coalesce(t.label,p.label) as label, count(*) filter (t.idx is not null and p.idx is not null) tp,
      count(*) filter (p.idx is null) fn, count(*) filter (t.idx is null) fp
      from c_truth t full join c_predicted p on p.idx=t.idx and p.label=t.label group by 1)
    select avg(2.0*tp/(2*tp+fp+fn)) macro_f1, 2.0*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)) micro_f1, count(*) n_labels,
    (select count(distinct idx) from c_truth) n_tests from k""",
)


@query("multilabel_f1", "select round(macro_f1,6)+0.0 macro_f1, round(micro_f1,6)+0.0 micro_f1, n_labels, n_tests from c_f1")
def multilabel_f1(spark, d):
    t = truth(spark, d)
    return rounded(cl.f1_scores(t, cl.predicted_labels(t, scored(spark, d))), "macro_f1", "micro_f1")


@query(
    "example_f1",
    """with h as (select t.idx, count(*) t, count(p.idx) h from c_truth t left join c_predicted p on p.idx=t.idx and p.label=t.label group by t.idx),
    a as (select avg(h/t) x from h)
    select round(x,6)+0.0 "precision", round(x,6)+0.0 recall, round(x,6)+0.0 f1 from a""",
)
def example_f1(spark, d):
    t = truth(spark, d)
    return rounded(cl.example_f1(t, cl.predicted_labels(t, scored(spark, d))), "precision", "recall", "f1")


# A second run predicts the labels of the lowest scores.
cte("c_predicted_low", CTES["c_predicted"].replace("score desc", "score"))
cte("c_f1_low", CTES["c_f1"].replace("c_predicted", "c_predicted_low"))


@query(
    "mean_f1",
    """select round((a.macro_f1+b.macro_f1)/2,6)+0.0 macro_f1, round((a.micro_f1+b.micro_f1)/2,6)+0.0 micro_f1
    from c_f1 a cross join c_f1_low b""",
)
def mean_f1(spark, d):
    t, s = truth(spark, d), scored(spark, d)
    high = cl.f1_scores(t, cl.predicted_labels(t, s))
    low = cl.f1_scores(t, cl.predicted_labels(t, s.withColumn("score", -F.col("score"))))
    return rounded(cl.mean_scores(high.unionByName(low)), "macro_f1", "micro_f1")


@query(
    "label_candidates",
    "select idx, count(*) n, string_agg(label, ',' order by label) as labels from c_truth group by idx",
)
def label_candidates(spark, d):
    return cl.candidates(truth(spark, d)).withColumn("labels", F.array_join("labels", ","))


@query(
    "labelled_instances",
    """select idx, label, k, round(embedding[k+1]::double,6)+0.0 x from
    (select v.vec_id idx, t.label, v.embedding, unnest(range(0,len(v.embedding))) k from embeddings v join c_truth t on t.idx=v.vec_id)""",
)
def labelled_instances(spark, d):
    rows = cl.label_rows(vectors(spark, d).drop("label"), truth(spark, d))
    return longs(rows.select("idx", "label", F.posexplode("vec").alias("k", "x")), "k").withColumn("x", r("x"))


@query(
    "evaluation_split",
    "select true train, cast(floor(count(*)*0.3)+1 as bigint) n from documents union all select false, cast(count(*)-floor(count(*)*0.3)-1 as bigint) from documents",
)
def evaluation_split(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"))
    return cl.split(docs, "idx", 0.3).groupBy("train").agg(F.count("*").alias("n"))


@query(
    "fold_sizes",
    """with n as (select count(*) l from documents), f as (select unnest(range(7)) f)
    select f::bigint fold, ((f+1)*l//7 - f*l//7)::bigint n from n, f""",
)
def fold_sizes(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return ln.folds(docs, "doc_id", 7).groupBy("fold").agg(F.count("*").alias("n"))
