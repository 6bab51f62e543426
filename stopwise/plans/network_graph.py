"""Queries of the station graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.config import EVENTS as C
from stopwise.operators import graph as gr
from stopwise.plans.core import journeys, labels, ordered, shared
from stopwise.plans.domain import DAYS, NET, flags, points, prior, q, rounded, segments, stations

P = "trip_key, stop_seq"
G = NET | {
    "ge": f"select station_id as from_station_id, next_station_id as to_station_id, count(*) as n_runs, median((epoch(next_arr_planned) - epoch(dep_planned)) / 60.0) as run_planned_min from ordered where next_station_id is not null group by all having count(*) >= {C.min_edge_runs}",
    "gs": "select station_id, count(*) / count(distinct operating_day) as daily_stops from ordered group by all",
    "gp": "select trip_key, stop_seq, target_seq, m_end from pts where horizon_min = 15",
    "gr": "select p.trip_key, p.stop_seq, j.station_id, case when j.stop_seq = p.stop_seq then 0 when j.stop_seq = p.target_seq then 2 else 1 end as role, (j.stop_seq - p.stop_seq)::int as hop, if(j.stop_seq = p.stop_seq, 0, (epoch(coalesce(j.arr_planned, j.dep_planned)) - epoch(o.dep_planned)) / 60.0) as planned_min from gp p join journeys j on j.trip_key = p.trip_key and j.stop_seq between p.stop_seq and p.target_seq join journeys o on o.trip_key = p.trip_key and o.stop_seq = p.stop_seq",
    "gu": "select from_station_id as a, to_station_id as b from ge union select to_station_id, from_station_id from ge",
    "gn": "select distinct r.trip_key, r.stop_seq, b as station_id from gr r join gu on a = r.station_id where not exists (select 1 from gr x where x.trip_key = r.trip_key and x.stop_seq = r.stop_seq and x.station_id = gu.b)",
    "ga": "select * from gr union all select trip_key, stop_seq, station_id, 3, null, null from gn",
    "gpos": "select a.*, daily_stops, row_number() over (partition by trip_key, stop_seq order by role = 3, hop nulls last, round(daily_stops, 6) desc nulls last, a.station_id) - 1 as pos, count(*) over (partition by trip_key, stop_seq) as found from ga a left join gs on gs.station_id = a.station_id",
    "nodes": f"select * from gpos where pos < {C.max_nodes}",
    "ee": "select x.trip_key, x.stop_seq, x.pos as from_pos, y.pos as to_pos, from_station_id, to_station_id, coalesce(x.role < 3 and y.role < 3 and y.hop = x.hop + 1, false) as on_route, n_runs, run_planned_min from nodes x join ge on from_station_id = x.station_id join nodes y on y.trip_key = x.trip_key and y.stop_seq = x.stop_seq and y.station_id = to_station_id",
    "ei": "select *, row_number() over (partition by trip_key, stop_seq order by on_route desc, n_runs desc, from_pos, to_pos) - 1 as eid, count(*) over (partition by trip_key, stop_seq) as found from ee",
    "edges": f"select * from ei where eid < {C.max_edges}",
}


def graph_points(s, d):
    return points(s, d).where("horizon_min = 15")


def static(s, d):
    return shared(s, d, "graph_static", lambda: gr.static_edges(ordered(s, d), C))


def graph_nodes(s, d):
    """Nodes of the points, stored once a session; no edge is made for a query that reads nodes alone."""
    return shared(s, d, "graph_nodes", lambda: gr.subgraph_nodes(graph_points(s, d), journeys(s, d), static(s, d), gr.static_stations(ordered(s, d)), C))


def graph_edges(s, d):
    return shared(s, d, "graph_edges", lambda: gr.subgraph_edges(graph_nodes(s, d), static(s, d), C))


def node_x(s, d):
    return gr.node_features(graph_nodes(s, d), graph_points(s, d), stations(s, d))


def edge_x(s, d):
    return gr.edge_features(graph_edges(s, d), graph_points(s, d), segments(s, d))


def feature_tables(s, d):
    return graph_nodes(s, d), graph_edges(s, d), node_x(s, d), edge_x(s, d)


def in_window(table: str, alias: str, v: str, w: int) -> str:
    return f"coalesce(sum({alias}.{v}) filter (where minute > m_end - {w}), 0)"


_node = lambda w: f"ln(1 + {in_window('ms', 'ms', 'n', w)}) as log_n_{w}, coalesce({in_window('ms', 'ms', 's', w)} / nullif({in_window('ms', 'ms', 'n', w)}, 0), 0) as mean_delay_{w}, coalesce({in_window('ms', 'ms', 'l', w)} / nullif({in_window('ms', 'ms', 'n', w)}, 0), 0) as share_late_{w}"
_edge = lambda w: f"ln(1 + {in_window('mg', 'mg', 'n', w)}) as log_n_{w}, coalesce({in_window('mg', 'mg', 's', w)} / nullif({in_window('mg', 'mg', 'n', w)}, 0), 0) as mean_gain_{w}"
X = G | {
    "nx": f"select n.trip_key, n.stop_seq, pos, {', '.join(map(_node, (10, 30, 60)))}, {', '.join(f'(any_value(role) = {i})::int::double as is_{r}' for i, r in enumerate(gr.ROLES))}, coalesce(any_value(hop), 0)::double as route_offset, "
    "coalesce(any_value(planned_min), 0) as planned_min, ln(1 + any_value(daily_stops)) as log_traffic from nodes n join gp using (trip_key, stop_seq) left join ms on ms.station_id = n.station_id and minute > m_end - 60 and minute <= m_end group by all",
    "ex": f"select e.trip_key, e.stop_seq, eid, ln(1 + any_value(n_runs)) as log_runs, any_value(run_planned_min) as run_planned_min, any_value(on_route)::int::double as on_route, {', '.join(map(_edge, (10, 30)))} "
    "from edges e join gp using (trip_key, stop_seq) left join mg on mg.from_station_id = e.from_station_id and mg.to_station_id = e.to_station_id and minute > m_end - 30 and minute <= m_end group by all",
}
_rounded = lambda cs: ", ".join(f"round({c}, 6) + 0 as {c}" for c in cs)


def six(df, columns):
    """The columns to six digits, without a negative zero."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


q("K32_static_graph", "select from_station_id, to_station_id, n_runs, round(run_planned_min, 6) as run_planned_min from ge", G, lambda s, d: rounded(gr.static_edges(ordered(s, d), C)))
q("K33_subgraph_nodes", f"select {P}, pos, station_id, role, hop, found from nodes", G, lambda s, d: graph_nodes(s, d).drop("daily_stops", "planned_min"))
q("K34_subgraph_edges", f"select {P}, eid, from_pos, to_pos, on_route, n_runs, found from edges", G, lambda s, d: graph_edges(s, d).drop("run_planned_min", "from_station_id", "to_station_id"))
q("K35_subgraph_features", f"select {P}, pos, {_rounded(gr.NODE_FEATURES)} from nx", X, lambda s, d: six(node_x(s, d), gr.NODE_FEATURES))
q("K35_edge_features", f"select {P}, eid, {_rounded(gr.EDGE_FEATURES)} from ex", X, lambda s, d: six(edge_x(s, d), gr.EDGE_FEATURES))


def packed(s, d):
    """The packed arrays, with the sums of the feature arrays in their place, of the nodes and edges that have all their features."""
    own = lambda c: F.transform(c, lambda x: F.coalesce(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.lit(0.0)))
    total = lambda c: F.round(F.aggregate(own(c), F.lit(0.0), lambda a, x: a + x), 4) + F.lit(0.0)
    return gr.pack_subgraphs(*feature_tables(s, d), C).withColumns({"node_x": total("node_x"), "edge_x": total("edge_x")})


_sum = lambda cs: " + ".join(cs)
q("K36_pack_subgraphs", f"select *, list_resize(coalesce(f, []), {C.max_edges}, -1) as edge_from_pos, list_resize(coalesce(t, []), {C.max_edges}, -1) as edge_to_pos from "
  f"(select {P}, count(*)::int as n_nodes, max(found) - count(*) as dropped_nodes, list_resize(list(station_id order by pos), {C.max_nodes}, 0) as node_station_id, round(sum({_sum(gr.NODE_FEATURES).replace('planned_min', 'nx.planned_min')}), 4) + 0 as node_x from nodes join nx using ({P}, pos) group by all) "
  f"left join (select {P}, count(*)::int as n_edges, max(found) - count(*) as dropped_edges, list(from_pos order by eid) as f, list(to_pos order by eid) as t, round(sum({_sum(gr.EDGE_FEATURES).replace('run_planned_min', 'ex.run_planned_min').replace('on_route', 'ex.on_route')}), 4) + 0 as edge_x from edges join ex using ({P}, eid) group by all) using ({P})".replace("select *, list_resize", f"select {P}, n_nodes, coalesce(n_edges, 0)::int as n_edges, dropped_nodes, coalesce(dropped_edges, 0) as dropped_edges, node_station_id, node_x, coalesce(edge_x, 0) as edge_x, list_resize"), X, packed)
HOPS = G | {"ue": "select trip_key, stop_seq, from_pos as a, to_pos as b from edges union select trip_key, stop_seq, to_pos, from_pos from edges",
            "h0": "select trip_key, stop_seq, pos as a, pos as b, 0 as h from nodes"} | {
    f"h{i}": f"select trip_key, stop_seq, a, b, min(h) as h from (select * from h{i - 1} union all select x.trip_key, x.stop_seq, x.a, u.b, {i} from h{i - 1} x join ue u on u.trip_key = x.trip_key and u.stop_seq = x.stop_seq and u.a = x.b where x.h = {i - 1}) group by all" for i in range(1, 7)}
q(
    "K37_hop_distances",
    "select trip_key, stop_seq, sqrt(count(*))::int as n, string_agg('0' || hops, '' order by a, b) as hops from (select x.trip_key, x.stop_seq, x.pos as a, y.pos as b, coalesce(h, 7)::int as hops "
    "from nodes x join nodes y on y.trip_key = x.trip_key and y.stop_seq = x.stop_seq left join h6 on h6.trip_key = x.trip_key and h6.stop_seq = x.stop_seq and h6.a = x.pos and h6.b = y.pos) group by all",
    HOPS, lambda s, d: gr.hop_matrix(graph_nodes(s, d), graph_edges(s, d)).select("trip_key", "stop_seq", "n", F.hex("hops").alias("hops")),
)
_md = lambda end: f"('0x' || substr(md5(e.trip_key || '|' || e.stop_seq || '|' || eid || '|{end}' || '|3'), 1, 8))::bigint % n"


def rewired(s, d):
    return gr.rewire_edges(graph_edges(s, d), graph_nodes(s, d), 3)


q("K38_rewire_edges", f"select e.trip_key, e.stop_seq, eid, {_md('a')} as from_pos, {_md('b')} as to_pos from edges e join (select {P}, count(*) as n from nodes group by all) using ({P})", G, rewired)


def moments(s, d):
    n, e = node_x(s, d), edge_x(s, d)
    both = [gr.feature_moments(x, cs).select(F.lit(what).alias("what"), "feature", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std")) for what, x, cs in (("node", n, gr.NODE_FEATURES), ("edge", e, gr.EDGE_FEATURES))]
    return both[0].union(both[1])


q("K39_feature_moments", " union all ".join(f"select '{what}' as what, '{c}' as feature, round(avg({c}), 5) as mean, round(stddev_pop({c}) + 1e-6, 5) as std from {t}" for what, t, cs in (("node", "nx", gr.NODE_FEATURES), ("edge", "ex", gr.EDGE_FEATURES)) for c in cs), X, moments)
q("K41_daily_delay_series", "select operating_day, round(mean_delay_min, 6) as mean_delay_min, round(cancelled_runs_share, 6) as cancelled_runs_share, is_disruption_day from flags", DAYS,
  lambda s, d: rounded(flags(s, d).select("operating_day", "mean_delay_min", "cancelled_runs_share", "is_disruption_day")))


def showcase(s, d):
    guesses = prior(s, d).select("trip_key", "stop_seq", "horizon_min", F.col("pred_historical").alias("prediction"))
    return six(gr.showcase(labels(s, d), journeys(s, d), guesses, C), ["d0_min", "target_delay_min", "delta_min", "prediction"])


SHOW = DAYS | {
    "s0": "select distinct operating_day, category, line_name, trip_key, stop_seq, d0_min, case when d0_min < 1 then '<1' when d0_min < 3 then '1-3' when d0_min < 10 then '3-10' else '>10' end as d0_bucket, "
    "('0x' || substr(md5(trip_key || '|' || stop_seq || '|9'), 1, 8))::bigint % 1073741824 as h from labels_ where in_common_subset and line_name is not null",
    "s1": "select * from s0 qualify row_number() over (partition by operating_day order by h, trip_key, stop_seq) = 1",
    "s2": "select * from s1 qualify row_number() over (partition by d0_bucket, category, line_name order by h, trip_key, stop_seq) = 1",
    "s3": "select d0_bucket, trip_key, stop_seq from s2 qualify row_number() over (partition by d0_bucket order by h, trip_key, stop_seq) <= 5",
    "sn": "select station_id, mode(station_name) as name from journeys group by station_id",
}
q("K40_showcase", "select d0_bucket, l.trip_key, l.stop_seq, l.horizon_min, l.category || ' ' || l.line_name as train, l.train_number, dayname(l.operating_day) as weekday, a.name as origin, strftime(l.dep_planned, '%H:%M') as planned, round(l.d0_min, 6) + 0 as d0_min, "
  "b.name as target, strftime(l.target_arr_planned, '%H:%M') as target_planned, round(l.target_delay_min, 6) + 0 as target_delay_min, round(l.delta_min, 6) + 0 as delta_min, round(pred_historical, 6) + 0 as prediction from s3 join labels_ l using (trip_key, stop_seq) "
  "left join prior p on p.trip_key = l.trip_key and p.stop_seq = l.stop_seq and p.horizon_min = l.horizon_min left join sn a on a.station_id = l.station_id left join sn b on b.station_id = l.target_station_id", SHOW, showcase)
q("F04_diverse_pick", "select * from s3", SHOW, lambda s, d: showcase(s, d).select("d0_bucket", "trip_key", "stop_seq").distinct())
