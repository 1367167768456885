"""Contact map and interaction graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.catalog.base import longs, r, rounded
from loopweave.catalog.domain import dump, edges, nodes, significance, table
from loopweave.catalog.registry import cte, query
from loopweave.operators import contacts as ct

BASE = 40
#: Base quota of the reference's workload.
REFERENCE_BASE = 2000


@query("contact_dump", "select chrom1,pos1,chrom2,pos2,weight from c_dump")
def contact_dump(spark, d):
    return dump(spark, d)


@query("contact_index", "select id1,id2,weight from c_edges")
def contact_index(spark, d):
    return edges(spark, d)


@query(
    "contact_positions",
    """select n1.chrom chrom1, n1.pos*1000 pos1, n2.chrom chrom2, n2.pos*1000 pos2, weight
    from c_edges join c_nodes n1 on n1.idx=id1 join c_nodes n2 on n2.idx=id2""",
)
def contact_positions(spark, d):
    return ct.positions_of_edges(edges(spark, d), nodes(spark, d), 1000)


@query(
    "contact_list_without_index",
    """select chrom1, pos1//4 pos1, chrom2, pos2//4 pos2, weight from c_dump where weight is not null""",
)
def contact_list_without_index(spark, d):
    return ct.drop_missing(ct.bin_contacts(dump(spark, d), 4))


@query("contact_genome_wide", "select id1,id2,weight from c_edges where id1<>id2")
def contact_genome_wide(spark, d):
    return ct.without_loops(edges(spark, d))


RANK = """select *, row_number() over (partition by chrom1,chrom2 order by weight desc,pos1,pos2) rn
    from c_dump where pos1<>pos2"""


@query("strongest_contacts", f"select chrom1,pos1,chrom2,pos2,weight from ({RANK}) where rn<=20")
def strongest_contacts(spark, d):
    return ct.strongest(dump(spark, d), 20)


PRANK = """select *, row_number() over (partition by chrom1,chrom2 order by p,pos1,pos2) rn
    from c_pval where chrom1<>chrom2 or pos1<>pos2"""


@query(
    "most_significant_contacts",
    f"select chrom1,pos1,chrom2,pos2,round(p,6)+0.0 pvalue from ({PRANK}) where rn<=15",
)
def most_significant_contacts(spark, d):
    return rounded(ct.most_significant(significance(spark, d), 15), "pvalue").drop("weight")


cte("c_size", "select chrom, count(*) n from c_nodes group by chrom")
cte(
    "c_quota",
    f"""select x.chrom chrom1, y.chrom chrom2,
    cast(floor({BASE}*((x.n/(select min(n) from c_size)::double)*(y.n/(select min(n) from c_size)::double))) as bigint) k
    from c_size x join c_size y on x.chrom<=y.chrom""",
)


@query("pair_quotas", "select chrom1,chrom2,k from c_quota")
def pair_quotas(spark, d):
    return ct.pair_quotas(nodes(spark, d), BASE)


GRAPH = """select n1.idx id1, n2.idx id2, 1::bigint weight from ({rank}) r
    join c_quota q on q.chrom1=r.chrom1 and q.chrom2=r.chrom2 and rn<=k {extra}
    join c_nodes n1 on n1.chrom=r.chrom1 and n1.pos=r.pos1
    join c_nodes n2 on n2.chrom=r.chrom2 and n2.pos=r.pos2"""
cte("c_graph1", GRAPH.format(rank=RANK, extra=""))
cte("c_graph", "select id1,id2,weight from c_graph1 union all select id2,id1,weight from c_graph1")


def graph(spark, d, **kw):
    return longs(ct.quota_graph(dump(spark, d), nodes(spark, d), BASE, **kw), "weight")


@query("quota_graph", "select id1,id2,weight from c_graph")
def quota_graph(spark, d):
    return graph(spark, d)


@query(
    "quota_graph_significance",
    f"""with g as ({GRAPH.format(rank=PRANK, extra="")})
    select id1,id2,weight from g union all select id2,id1,weight from g""",
)
def quota_graph_significance(spark, d):
    return longs(
        ct.quota_graph(significance(spark, d), nodes(spark, d), BASE, by="pvalue"), "weight"
    )


cte("c_quota_reference", f"select chrom1, chrom2, cast(floor({REFERENCE_BASE}*((x.n/(select min(n) from c_size)::double)*(y.n/(select min(n) from c_size)::double))) as bigint) k from (select chrom chrom1, n from c_size) x join (select chrom chrom2, n from c_size) y on chrom1<=chrom2")


@query(
    "quota_graph_reference_base",
    f"""with g as ({GRAPH.format(rank=RANK, extra="").replace("c_quota", "c_quota_reference")})
    select id1,id2,weight from g union all select id2,id1,weight from g""",
)
def quota_graph_reference_base(spark, d):
    return longs(ct.quota_graph(dump(spark, d), nodes(spark, d), REFERENCE_BASE), "weight")


@query("quota_graph_intra", GRAPH.format(rank=RANK, extra="and q.chrom1=q.chrom2"))
def quota_graph_intra(spark, d):
    return graph(spark, d, intra=True, symmetric=False)


INDEXED_P = """select n1.idx id1, n2.idx id2, p, chrom1, chrom2, pos1, pos2 from c_pval
    join c_nodes n1 on n1.chrom=chrom1 and n1.pos=pos1 join c_nodes n2 on n2.chrom=chrom2 and n2.pos=pos2"""


@query(
    "significant_intra",
    f"select id1,id2,1::bigint weight from ({INDEXED_P}) where chrom1=chrom2 and p<0.2",
)
def significant_intra(spark, d):
    return longs(ct.significant_intra(significance(spark, d), nodes(spark, d), 0.2), "weight")


@query(
    "significance_threshold",
    "select chrom1,pos1,chrom2,pos2,true as edge from c_pval where p<0.05",
)
def significance_threshold(spark, d):
    return significance(spark, d).filter("pvalue < 0.05").select(*ct.PAIR, F.lit(True).alias("edge"))


@query(
    "significant_by_distance",
    f"""select id1,id2,1::bigint weight,th threshold from ({INDEXED_P})
    join (values (0.5::double),(0.2::double),(0.05::double)) t(th) on p<=th
    where chrom1=chrom2 and pos1<>pos2 and abs(pos2-pos1)<=6""",
)
def significant_by_distance(spark, d):
    out = ct.significant_by_distance(significance(spark, d), nodes(spark, d), [0.5, 0.2, 0.05], 6)
    return longs(out, "weight")


@query(
    "inter_graph",
    """with e as (select n1.idx id1, n2.idx id2, round(asinh(weight),6)+0.0 weight from c_dump
      join c_nodes n1 on n1.chrom=chrom1 and n1.pos=pos1 join c_nodes n2 on n2.chrom=chrom2 and n2.pos=pos2
      where chrom1<chrom2 and weight>=1)
    select id1,id2,weight from e union all select id2,id1,weight from e""",
)
def inter_graph(spark, d):
    return rounded(ct.inter_graph(dump(spark, d), nodes(spark, d)), "weight")


SWAP = "select id1,id2,weight from {0} union all select id2,id1,weight from {0}"


@query("edges_symmetric", SWAP.format("c_edges"))
def edges_symmetric(spark, d):
    return ct.swap_union(edges(spark, d))


@query("edges_one_direction", "select id1,id2,weight from c_edges where id1<>id2 order by id1,id2")
def edges_one_direction(spark, d):
    return ct.without_loops(edges(spark, d)).orderBy("id1", "id2")


@query("edges_both_directions", f"with e as (select * from c_edges where id1<>id2) {SWAP.format('e')}")
def edges_both_directions(spark, d):
    return ct.both_directions(edges(spark, d))


@query(
    "edges_both_directions_with_loops",
    "select id1,id2,weight from c_edges union all select id2,id1,weight from c_edges where id1<>id2",
)
def edges_both_directions_with_loops(spark, d):
    return ct.both_directions_with_loops(edges(spark, d))


@query(
    "matrix_mirror",
    "select id1,id2,weight from c_edges union all select id2,id1,weight from c_edges where id1<>id2",
)
def matrix_mirror(spark, d):
    return ct.mirror_upper(edges(spark, d))


@query(
    "merge_contact_lists",
    """with a as (select id1,id2,weight from c_edges where id1%2=0), b as (select id1,id2,weight from c_edges where id1%3=0),
    u as (select * from a union all select * from b), s as (select id1,id2,weight from u union all select id2,id1,weight from u)
    select id1,id2,cast(trunc(weight) as bigint) weight from (select distinct * from s)""",
)
def merge_contact_lists(spark, d):
    e = edges(spark, d)
    return ct.merge_lists([e.filter("id1 % 2 = 0"), e.filter("id1 % 3 = 0")], bidirectional=True)


@query("matrix_cells", "select pos1,pos2,sum(weight) weight from c_dump group by pos1,pos2")
def matrix_cells(spark, d):
    return ct.sum_duplicates(dump(spark, d), ["pos1", "pos2"])


@query("matrix_short_range", "select id1,id2,weight from c_edges where abs(id1-id2)<50")
def matrix_short_range(spark, d):
    return ct.short_range(edges(spark, d), 50)


@query(
    "matrix_drop_empty",
    """with e as (select id1,id2,weight from c_edges where id2%5<>0),
    a as (select id2 i from e group by id2 having sum(weight)<>0)
    select id1,id2,weight from e where id1 in (select i from a) and id2 in (select i from a)""",
)
def matrix_drop_empty(spark, d):
    return ct.drop_empty(edges(spark, d).withColumn("weight", F.expr("if(id2 % 5 = 0, null, weight)")))


@query(
    "matrix_drop_indices",
    """with x as (select idx from c_nodes where idx%11=3)
    select id1,id2,weight from c_edges where id1 not in (select idx from x) and id2 not in (select idx from x)""",
)
def matrix_drop_indices(spark, d):
    return ct.drop_indices(edges(spark, d), nodes(spark, d).filter("idx % 11 = 3").select("idx"))


@query(
    "matrix_renumbered",
    """with x as (select idx from c_nodes where idx%11=3),
    e as (select id1,id2,weight from c_edges where id1 not in (select idx from x) and id2 not in (select idx from x)),
    n as (select idx, row_number() over (order by idx)-1 k from (select id1 idx from e union select id2 from e))
    select a.k id1, b.k id2, weight from e join n a on a.idx=id1 join n b on b.idx=id2""",
)
def matrix_renumbered(spark, d):
    kept = ct.drop_indices(edges(spark, d), nodes(spark, d).filter("idx % 11 = 3").select("idx"))
    return longs(ct.renumbered(kept)[0], "id1", "id2")


@query(
    "lifted_pairs",
    """select o_orderkey line, 'chr'||(o_custkey%22+1) chrom1, o_custkey*1800 start1, o_custkey*1800+1+(o_orderkey*311)%9000 end1,
    'chr'||(o_orderkey%22+1) chrom2, o_orderkey*240 start2, o_orderkey*240+1+(o_orderkey*733)%9000 end2, o_custkey%10 weight
    from orders where o_custkey%7<>0 and o_orderkey%5<>0""",
)
def lifted_pairs(spark, d):
    """Halves that a lift-over lost are there without a place."""
    rows = table(spark, d, "orders")

    def half(key: str, width: int, factor: int, lost: int):
        start = F.col(key) * width
        return rows.select(
            F.col("o_orderkey").alias("line"),
            F.when(F.col(key) % lost != 0, F.concat(F.lit("chr"), (F.col(key) % 22 + 1).cast("string"))).alias("chrom"),
            start.alias("start"), (start + 1 + (F.col("o_orderkey") * factor) % 9000).alias("end"),
            (F.col("o_custkey") % 10).alias("weight"),
        )

    return ct.rejoined(half("o_custkey", 1800, 311, 7), half("o_orderkey", 240, 733, 5))


@query(
    "matrix_window",
    """select distinct * from (
    select id1-10 \"row\", id2-30 col, weight from c_edges where id1 between 10 and 400 and id2 between 30 and 900
    union all select id2-10, id1-30, weight from c_edges where id2 between 10 and 400 and id1 between 30 and 900)""",
)
def matrix_window(spark, d):
    return ct.window_cells(edges(spark, d), 10, 400, 30, 900)


@query(
    "matrix_vector_product",
    """select id1 idx, round(sum(weight*price),4)+0.0 as value from (
    select id1,id2,weight from c_edges union all select id2,id1,weight from c_edges where id1<>id2) e
    join c_nodes on idx=id2 group by id1""",
)
def matrix_vector_product(spark, d):
    from loopweave.operators.balance import multiply

    cells = ct.both_directions_with_loops(edges(spark, d))
    return rounded(multiply(cells, nodes(spark, d).select("idx", F.col("price").alias("value"))), "value", digits=4)


@query(
    "fragment_marginals",
    """with e as (select chrom1 chrom,pos1 pos,weight from c_dump union all
      select chrom2,pos2,weight from c_dump where chrom1<>chrom2 or pos1<>pos2)
    select chrom, 0::bigint extra, pos*1000+500 mid, cast(trunc(sum(weight)) as bigint) weight, 1::bigint mappable
    from e group by chrom,pos""",
)
def fragment_marginals(spark, d):
    return ct.fragment_marginals(dump(spark, d), 1000)


@query(
    "vertex_degrees",
    "select idx, sum(weight) degree from (select id1 idx,weight from c_edges union all select id2,weight from c_edges) group by idx",
)
def vertex_degrees(spark, d):
    return ct.degrees(edges(spark, d))


@query(
    "edge_lookup",
    """select a.idx id1, b.idx id2, exists(select 1 from c_graph e where e.id1=a.idx and e.id2=b.idx) connected
    from c_nodes a join c_nodes b on b.idx = (a.idx*37+11)%1000""",
)
def edge_lookup(spark, d):
    n = nodes(spark, d).select("idx")
    wanted = n.select(F.col("idx").alias("id1"), ((F.col("idx") * 37 + 11) % 1000).alias("id2"))
    wanted = wanted.join(n.withColumnRenamed("idx", "id2"), "id2", "left_semi")
    return ct.has_edge(graph(spark, d), wanted)


@query(
    "edge_lookup_all_bins",
    """with e as (select id1,id2 from c_edges where weight>0 union select id2,id1 from c_edges where weight>0),
    p as (select idx id1, (idx*37+11)%(select count(*) from c_nodes) id2 from c_nodes)
    select p.id1, p.id2, e.id1 is not null connected from p left join e on e.id1=p.id1 and e.id2=p.id2""",
)
def edge_lookup_all_bins(spark, d):
    """Every bin asks for one partner, spread over all bins, in the whole contact map."""
    n = nodes(spark, d).select("idx")
    wanted = n.select(F.col("idx").alias("id1"), ((F.col("idx") * 37 + 11) % n.count()).alias("id2"))
    return ct.has_edge(ct.swap_union(edges(spark, d)), wanted)


@query("node_neighbours", "select id2 idx, weight from c_graph where id1=100")
def node_neighbours(spark, d):
    return ct.neighbours(graph(spark, d), 100)


@query(
    "label_pair_matrix",
    """select a.idx%4 label1, b.idx%4 label2, sum(weight) n from c_edges join c_nodes a on a.idx=id1 join c_nodes b on b.idx=id2 group by 1,2""",
)
def label_pair_matrix(spark, d):
    from loopweave.operators.mrf import transition_counts

    labels = nodes(spark, d).select("idx", (F.col("idx") % 4).alias("label"))
    return transition_counts(edges(spark, d), labels)


@query(
    "network_vertices",
    """with e as (select l_orderkey*10+l_linenumber line, 'p'||l_partkey u, 's'||l_suppkey v from lineitem),
    o as (select u name, line*2 at0 from e union all select v, line*2+1 from e),
    f as (select name, min(at0) at0 from o group by name)
    select name, row_number() over (order by at0,name)-1 id from f""",
)
def network_vertices(spark, d):
    from loopweave.sources.graphs import vertex_ids

    e = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("u"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("v"),
    )
    return vertex_ids(e)


@query(
    "network_reversed_pairs",
    """select l_orderkey a, l_partkey b, 1::bigint weight from lineitem union all
    select l_partkey, l_orderkey, 1::bigint from lineitem""",
)
def network_reversed_pairs(spark, d):
    from loopweave.sources.graphs import undirected_unit_edges

    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return longs(undirected_unit_edges(e), "weight")


@query(
    "adjacency_lists",
    "select id1 node, 0::bigint part, list(id2 order by id2) neighbours, count(*)::bigint n from c_graph group by id1",
)
def adjacency_lists(spark, d):
    from loopweave.sources.graphs import adjacency

    a = adjacency(graph(spark, d).drop("weight"))
    return a.select("node", "part", F.transform("neighbours", lambda x: x["dst"]).alias("neighbours"),
                    F.size("neighbours").cast("bigint").alias("n"))


@query(
    "adjacency_lists_whole_map",
    """with e as (select id1,id2 from c_edges union all select id2,id1 from c_edges where id1<>id2)
    select id1 node, 0::bigint part, list(id2 order by id2) neighbours, count(*)::bigint n from e group by id1""",
)
def adjacency_lists_whole_map(spark, d):
    from loopweave.sources.graphs import adjacency

    a = adjacency(ct.both_directions_with_loops(edges(spark, d)).drop("weight"))
    return a.select("node", "part", F.transform("neighbours", lambda x: x["dst"]).alias("neighbours"),
                    F.size("neighbours").cast("bigint").alias("n"))


@query(
    "densified_graph",
    """with e as (select id1 s,id2 t,weight::double w from c_graph), o as (select s,count(*) n,sum(w) sw from e group by s),
    dg as (select v, sum(w) degree from (select s v,w from e union all select t,w from e) group by v),
    src as (select dg.v from dg left join o on o.s=dg.v where coalesce(o.n,0)<=30),
    h1 as (select e.s, e.t, e.w f from e join src on src.v=e.s),
    h2 as (select h1.s, e.t, h1.f*e.w/o.sw f from h1 join e on e.s=h1.t join o on o.s=h1.t),
    al as (select v s, v t, degree/10.0 f from dg where v in (select v from src) union all select * from h1 union all select * from h2),
    rk as (select s,t,round(sum(f),6) weight from al group by s,t),
    tk as (select *, row_number() over (partition by s order by weight desc,t) rn from rk)
    select s id1,t id2,round(weight,6)+0.0 weight from tk where rn<=30
    union all select e.s,e.t,e.w from e join o on o.s=e.s where o.n> 30""",
)
def densified_graph(spark, d):
    from loopweave.operators.graph import densify

    return rounded(densify(graph(spark, d), max_neighbours=30, depth=2), "weight")
