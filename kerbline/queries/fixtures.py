"""The fixture views: restrictions, network, sites and predictions, derived from the given tables."""

from kerbline.queries.registry import VIEWS

VIEWS["fx_restrictions"] = """
select concat('R-', lpad(cast(o_orderkey as string), 7, '0')) as restriction_id,
       o_orderkey as k,
       cast(concat('-79.', lpad(cast(30000 + (o_orderkey * 7919) % 17000 as string), 5, '0')) as double) as lon,
       cast(concat('43.', lpad(cast(60000 + (o_orderkey * 104729) % 12000 as string), 5, '0')) as double) as lat,
       case when o_orderkey % 29 = 0 then 'BAD'
            when o_orderkey % 31 = 0 then ''
            else concat('[-79.', lpad(cast(30000 + (o_orderkey * 7919) % 17000 as string), 5, '0'),
                        ',43.', lpad(cast(60000 + (o_orderkey * 104729) % 12000 as string), 5, '0'),
                        '],[-79.', lpad(cast(30000 + (o_orderkey * 7919 + 37) % 17000 as string), 5, '0'),
                        ',43.', lpad(cast(60000 + (o_orderkey * 104729 + 53) % 12000 as string), 5, '0'), ']') end as polyline_text,
       case when o_orderkey % 4 = 0 then 'ROAD_CLOSED' else 'CONSTRUCTION' end as type,
       case o_orderpriority when '1-URGENT' then 'Major Arterial Road' when '2-HIGH' then 'Minor Arterial Road'
            when '3-MEDIUM' then 'Collector' else 'Local Road' end as road_class,
       case when o_orderkey % 3 = 0 then 'BOTH_DIRECTIONS' else 'ONE_DIRECTION' end as directions_affected,
       case o_orderkey % 5 when 0 then 'Continuous' when 1 then 'Daily' when 2 then 'Weekdays' when 3 then 'Weekends' else 'Weekdays' end as work_period,
       case when o_orderkey % 11 = 0 then 'Medium' when o_orderstatus = 'F' then 'None' when o_orderstatus = 'O' then 'Low' else 'High' end as curr_impact,
       n_name as district, concat('Contractor ', cast(o_custkey % 40 as string)) as contractor,
       o_orderdate as start_ts, l.end_ts as end_ts
from orders
left join (select l_orderkey, max(l_shipdate) as end_ts from lineitem group by l_orderkey) l on l.l_orderkey = o_orderkey
left join customer on c_custkey = o_custkey
left join nation on n_nationkey = c_nationkey
"""

VIEWS["fx_nodes"] = """
select k, k % w as col, cast(floor(k / w) as bigint) as rw, w,
       (k % w) * 60 + (k * 31) % 20 as x, cast(floor(k / w) as bigint) * 60 + (k * 17) % 20 as y
from (select cast(p_partkey as bigint) as k from part) p
cross join (select cast(floor(sqrt(count(*))) as bigint) as w from part) c
"""

VIEWS["fx_edges"] = """
select concat('S-', cast(a.k as string), '-', cast(c.dir as string)) as seg, a.k as u, b.k as v,
       sqrt(cast((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as double)) as len_m,
       case a.k % 4 when 0 then 'Sidewalk on both sides' when 1 then 'Sidewalk on one side' when 2 then '' else 'No sidewalk' end as sidewalk,
       case when a.k % 13 = 0 then 1 else 0 end as crosswalk,
       case when a.k % 17 = 0 then 'PX' else '' end as px_type,
       a.x as x1, a.y as y1, b.x as x2, b.y as y2
from (select k as u, k + 1 as v, 0 as dir from fx_nodes where (k + 1) % w <> 0
      union all select k as u, k + w as v, 1 as dir from fx_nodes) c
join fx_nodes a on a.k = c.u join fx_nodes b on b.k = c.v
where ((c.u * c.u * 31 + c.u * 17 + c.dir * 7) % 101) % 3 <> 0
"""

VIEWS["fx_sites"] = """
select concat('R-', lpad(cast(o_orderkey as string), 7, '0')) as restriction_id,
       (o_orderkey * 7919) % (m.w * 60) as x1, (o_orderkey * 104729) % (m.h * 60) as y1,
       (o_orderkey * 7919) % (m.w * 60) + (o_orderkey % 5) * 10 as x2, (o_orderkey * 104729) % (m.h * 60) + (o_orderkey % 3) * 10 as y2,
       case when o_orderkey % 29 = 0 then true else false end as malformed
from orders cross join (select max(w) as w, max(rw) + 1 as h from fx_nodes) m
"""

VIEWS["fx_predictions"] = """
select event_id, ts, user_id,
       case event_type when 'error' then 'High' when 'purchase' then 'Low' else 'None' end as prediction,
       least(1e0, value / 500e0) as confidence
from events
"""

VIEWS["fx_matches"] = """
select concat('R-', lpad(cast(l_orderkey as string), 7, '0')) as restriction_id, l_orderkey as k,
       concat('S-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as segment_id,
       case l_returnflag when 'A' then 'direct_intersection' when 'N' then 'proximity' else 'point_fallback' end as signal,
       case l_returnflag when 'A' then 'HIGH' when 'N' then 'MEDIUM' else 'LOW' end as confidence,
       case when l_returnflag = 'A' then null when l_linenumber % 3 = 0 then 2e0 when l_linenumber % 3 = 1 then 5e0 else 10e0 end as threshold_m,
       case when l_returnflag = 'A' then 0e0 else l_quantity / 5e0 end as distance_m, l_linenumber as pos
from lineitem
"""

VIEWS["fx_inputs"] = """
select r.restriction_id, r.k, r.polyline_text not in ('BAD', '') as valid_polyline, r.polyline_text in ('BAD', '') as fallback_used,
       coalesce(m.n, 0) as candidate_edge_count, coalesce(m.direct, 0) as direct_count, coalesce(m.near, 0) as proximity_count,
       coalesce(m.low, 0) as low_count, coalesce(m.len_m, 0e0) as affected_edge_length_m,
       case when r.k % 13 = 0 then null when r.k % 7 = 0 then 0e0 else (r.k % 300) / 1e0 end as added_distance_m,
       case when r.k % 13 = 0 then null when r.k % 7 = 0 then 1e0 else 1e0 + (r.k % 90) / 10e0 end as detour_ratio,
       case when r.k % 17 = 0 then true else false end as connectivity_lost,
       case when r.end_ts is null then 'ENDTIME' else '' end as missing_field, r.district, r.road_class, r.contractor, r.curr_impact,
       case when r.end_ts >= r.start_ts then (r.k % 2000) / 2e0 end as duration_hours, r.lon, r.lat
from fx_restrictions r
left join (select k, count(*) as n, sum(case when signal = 'direct_intersection' then 1 else 0 end) as direct,
                  sum(case when signal = 'proximity' then 1 else 0 end) as near, sum(case when signal = 'point_fallback' then 1 else 0 end) as low,
                  sum(cast(cast(distance_m * 10 as bigint) as double)) as len_m
           from fx_matches group by k) m on m.k = r.k
"""

VIEWS["fx_records"] = """
select restriction_id, k, case when k % 3 = 0 then 'EVALUATED' when k % 3 = 1 then 'PARTIALLY_EVALUATED' else 'INSUFFICIENT_EVIDENCE' end as evaluation_status,
       case when candidate_edge_count = 0 then 'NOT_EVALUATED' when connectivity_lost then 'SEVERE' when added_distance_m is null then 'NOT_EVALUATED'
            when added_distance_m = 0 then 'LOW' when added_distance_m >= 129.181e0 or detour_ratio >= 6.983e0 then 'HIGH' else 'MODERATE' end as impact_severity,
       case when candidate_edge_count = 0 then 'INSUFFICIENT_EVIDENCE' when fallback_used or low_count > 0 then 'LOW'
            when direct_count > 0 and proximity_count = 0 then 'HIGH' else 'MEDIUM' end as evidence_confidence,
       k % 3 = 0 as impact_evaluable, k % 4 = 0 as replacement_available, candidate_edge_count, affected_edge_length_m, added_distance_m, detour_ratio,
       connectivity_lost, duration_hours, road_class as road, district as name, contractor as from_road,
       case when k % 5 = 0 then '' else curr_impact end as to_road, lon, lat, direct_count, proximity_count, low_count, valid_polyline
from fx_inputs
"""
