"""The signal queries in DuckDB SQL, built from common table expressions."""

from __future__ import annotations

_CTES: dict[str, str] = {
    "base": """select user_id % 8 as rec, row_number() over (partition by user_id % 8 order by ts, event_id) - 1 as i,
        cast(round(value * 100) as bigint) as c from events""",
    "slow": """select rec, i, c, case (i // 20) % 3 when 2 then 4 when 1 then 55 else 100 end as amp,
        case (i // 100) % 3 when 0 then 0 when 1 then case when i % 2 = 0 then 8 else -8 end
          else case when i % 20 < 10 then 0 when i % 2 = 0 then 8 else -8 end end as effort,
        case when c % 97 = 0 then 127 when i % 20 < 8 and (i // 20) % 3 = 0 then 88 else 96 - c % 2 end as spo2,
        case when c % 89 = 0 then 511 else 60 + c % 30 end as pulse, 1 + (i // 60) % 6 as position from base""",
    "flow": """select rec, 4 * i + k as j, amp * case when (i // 40) % 2 = 0 then case when k % 2 = 0 then 1 else -1 end
        else case when i % 2 = 0 then 1 else -1 end end + c % 3 as flow from slow, (select unnest([0, 1, 2, 3]) as k)""",
    "env": """select rec, j, flow, sum(abs(flow)) over w as es, count(*) over w as en,
        cast(sum(abs(flow)) over w as double) / count(*) over w as env from flow
        window w as (partition by rec order by j rows between 2 preceding and 2 following)""",
    "down": "select rec, j // 4 as i, max(env) as env from env group by rec, j // 4",
    "pct": """select rec, i, fr[cast(least(floor(len(fr) * 0.95::double), len(fr) - 1) as bigint) + 1] as baseline from
        (select rec, i, list_sort(list(env) over (partition by rec order by i rows between 60 preceding and 60 following)) as fr from down)""",
    "knots": "select rec, i, baseline as b, coalesce(lead(baseline) over (partition by rec order by i), baseline) as nb from pct",
    "feat": """select e.rec, e.j, e.flow, e.es, e.en, e.env,
        k.b * (1 - (e.j % 4)::double / 4) + k.nb * ((e.j % 4)::double / 4) as baseline from env e join knots k on e.rec = k.rec and e.j // 4 = k.i""",
    "sp": """select *, case when vn > 0 then vs::double / vn else 95.0::double end as spo2_base from (select *,
        sum(case when spo2 between 50 and 100 then spo2 end) over w as vs, count(case when spo2 between 50 and 100 then spo2 end) over w as vn from slow
        window w as (partition by rec order by i rows between 60 preceding and 60 following))""",
    "tot": "select rec, count(*) as n, max(4 * i + 3) as last_j from slow group by rec",
    "apf": "select rec, j, env < baseline * 0.1::double and baseline > 1 as f from feat",
    "apr": """select rec, s / 4.0::double as start_sec, e / 4.0::double as end_sec from
        (select rec, min(j) as s, max(j) + 1 as e from (select rec, j, f, j - row_number() over (partition by rec, f order by j) as g from apf) where f group by rec, g)
        join tot using (rec) where e - s >= 40 and e <= last_j""",
    "apv": """select a.rec, a.start_sec, s.effort as x, row_number() over (partition by a.rec, a.start_sec order by s.i) - 1 as k,
        count(*) over (partition by a.rec, a.start_sec) as len from apr a join slow s on a.rec = s.rec and s.i >= floor(a.start_sec) and s.i < floor(a.end_sec)""",
    "apk": """select rec, start_sec,
        (count(*) * sum(x * x) - sum(x) * sum(x))::double / (count(*) * count(*)) as va,
        coalesce((sum(case when k < len // 2 then 1 else 0 end) * sum(case when k < len // 2 then x * x else 0 end) - sum(case when k < len // 2 then x else 0 end) * sum(case when k < len // 2 then x else 0 end))::double
          / nullif(sum(case when k < len // 2 then 1 else 0 end) * sum(case when k < len // 2 then 1 else 0 end), 0), 0) as vf,
        coalesce((sum(case when k < len // 2 then 0 else 1 end) * sum(case when k < len // 2 then 0 else x * x end) - sum(case when k < len // 2 then 0 else x end) * sum(case when k < len // 2 then 0 else x end))::double
          / nullif(sum(case when k < len // 2 then 0 else 1 end) * sum(case when k < len // 2 then 0 else 1 end), 0), 0) as vs
        from apv group by rec, start_sec""",
    "apc": """select a.rec, a.start_sec, a.end_sec, case when va is null then 'Unclassified' when va < 5 then 'Central' when vf < 5 and vs >= 5 then 'Mixed' else 'Obstructive' end as event_type
        from apr a left join apk using (rec, start_sec)""",
    "apneas": """select c.rec, c.event_type, c.start_sec, c.end_sec, {pos} as position,
        (select min(s.spo2)::double from slow s where s.rec = c.rec and s.spo2 between 50 and 100 and s.i >= floor(c.start_sec) and s.i < floor(c.end_sec + 30)) as spo2_nadir
        from apc c left join slow p on p.rec = c.rec and p.i = floor((c.start_sec + c.end_sec) / 2)""",
    "ds1": """select rec, i, spo2, spo2_base, spo2_base - spo2 >= 3 as f, row_number() over (partition by rec order by i) as o,
        lead(i) over (partition by rec order by i) as nx from sp where spo2 between 50 and 100""",
    "ds2": "select *, o - row_number() over (partition by rec, f order by i) as g from ds1",
    "dsr": """select rec, min(i) as s, arg_max(nx, i) as e, min(spo2)::double as nadir, arg_min(spo2_base, i) as b, max(i) as li from ds2 where f group by rec, g""",
    "desats": """select c.rec, 'Desaturation' as event_type, c.s::double as start_sec, c.e::double as end_sec, {pos} as position, c.nadir as spo2_nadir, c.b - c.nadir as spo2_drop
        from dsr c left join slow p on p.rec = c.rec and p.i = floor((c.s + c.e) / 2.0::double)
        where exists (select 1 from ds1 d where d.rec = c.rec and d.i > c.li) and c.e - c.s >= 2""",
    "hy1": """select rec, j, env / baseline <= 1 - 0.3::double and env / baseline > 0.1::double as f, row_number() over (partition by rec order by j) as o,
        lead(j) over (partition by rec order by j) as nx from feat where baseline >= 1""",
    "hy2": "select *, o - row_number() over (partition by rec, f order by j) as g from hy1",
    "hyr": """select rec, s / 4.0::double as start_sec, e / 4.0::double as end_sec from
        (select rec, min(j) as s, arg_max(nx, j) as e, max(j) as lj from hy2 where f group by rec, g) r
        where exists (select 1 from hy1 h where h.rec = r.rec and h.j > r.lj) and e - s >= 40""",
    "hyk": """select distinct h.rec, h.start_sec, h.end_sec from hyr h join sp s on s.rec = h.rec and s.spo2 between 50 and 100 and s.spo2_base - s.spo2 >= 3
        and s.i >= floor(h.start_sec) and s.i < floor(h.end_sec + 30)
        union select distinct h.rec, h.start_sec, h.end_sec from hyr h join desats d on d.rec = h.rec and d.start_sec < h.end_sec + 30 and d.end_sec > h.start_sec""",
    "hypopneas": """select c.rec, 'Hypopnea' as event_type, c.start_sec, c.end_sec, {pos} as position,
        (select min(s.spo2)::double from slow s where s.rec = c.rec and s.spo2 between 50 and 100 and s.i >= floor(c.start_sec) and s.i < floor(c.end_sec + 30)) as spo2_nadir
        from hyk c left join slow p on p.rec = c.rec and p.i = floor((c.start_sec + c.end_sec) / 2)""",
    "sm": """select rec, j, sum(es * (60 // en)) over w::double / count(*) over w as smooth from feat
        window w as (partition by rec order by j rows between 60 preceding and 60 following)""",
    "ext": """select rec, j, smooth > lag(smooth) over w and smooth > lead(smooth) over w as pk, smooth < lag(smooth) over w and smooth < lead(smooth) over w as tr
        from sm window w as (partition by rec order by j)""",
    "peaks": "{thin_pk}",
    "troughs": "{thin_tr}",
    "cyc": """select rec, j, nx, o, (nx - j) / 4.0::double between 40 and 90 as ok from (select rec, j, lead(j) over (partition by rec order by j) as nx,
        row_number() over (partition by rec order by j) as o from peaks)
        where rec in (select rec from peaks group by rec having count(*) >= 3) and rec in (select rec from troughs group by rec having count(*) >= 3)""",
    "csr0": """select rec, min(j) / 4.0::double as start_sec, max(nx) / 4.0::double as end_sec from
        (select *, o - row_number() over (partition by rec order by j) as g from cyc where ok) group by rec, g having count(*) >= 3""",
    "csr": """select c.rec, 'CheyneStokes' as event_type, c.start_sec, c.end_sec, {pos} as position
        from csr0 c left join slow p on p.rec = c.rec and p.i = floor((c.start_sec + c.end_sec) / 2)""",
    "sn1": "select rec, j, flow, w from (select rec, j, flow, unnest([j // 4, j // 4 - 1]) as w from flow) where w >= 0",
    "sn2": "select *, flow - lag(flow) over (partition by rec, w order by j) as d from sn1",
    "sn3": "select *, (d >= 0) != (lag(d) over (partition by rec, w order by j) >= 0) as cr from sn2",
    "snw": """select rec, w, rms, hf_ratio, zcr, hf_ratio > 0.5 and zcr > 0.3 and rms > 2 as snoring from (select rec, w, rms,
        case when rms > 0.1 then sqrt(dq::double / 7) / rms else 0 end as hf_ratio, cn / 6.0::double as zcr from (select rec, w, count(*) as n,
        sqrt(sum(flow * flow)::double / 8) as rms, sum(d * d) as dq, count(case when cr then 1 end) as cn from sn3 group by rec, w) where n = 8)""",
    "snr": """select rec, min(w) as s, max(w) + 1 as e from (select rec, w, snoring, w - row_number() over (partition by rec, snoring order by w) as g from snw)
        where snoring group by rec, g""",
    "snores": """select c.rec, 'Snore' as event_type, c.s::double as start_sec, c.e::double as end_sec, {pos} as position
        from snr c join (select rec, max(w) as lw from snw group by rec) using (rec) left join slow p on p.rec = c.rec and p.i = floor((c.s + c.e) / 2.0::double) where c.e <= lw""",
    "sent": """select rec, min(i) as s, max(i) + 1 as e from (select rec, i, f, i - row_number() over (partition by rec, f order by i) as g from
        (select rec, i, abs(spo2 - 127) < 0.5 as f from slow)) where f group by rec, g""",
    "sentp": """select rec, min(i) as s, max(i) + 1 as e from (select rec, i, f, i - row_number() over (partition by rec, f order by i) as g from
        (select rec, i, abs(pulse - 511) < 0.5 as f from slow)) where f group by rec, g""",
    "sentinels": "select * from sent union all select * from sentp",
    "mg": """select *, sum(nw) over (partition by rec order by s, e rows unbounded preceding) as g from (select *, case when pm is null or s > pm then 1 else 0 end as nw from
        (select *, max(e) over (partition by rec order by s, e rows between unbounded preceding and 1 preceding) as pm from sentinels))""",
    "excl": "select rec, min(s) as s, max(e) as e from mg group by rec, g",
    "evs": """select rec, 'Excluded' as event_type, s::double as start_sec, e::double as end_sec, 'Unknown' as position, null::double as spo2_nadir, null::double as spo2_drop, 0 as rank from excl
        union all select rec, event_type, start_sec, end_sec, position, spo2_nadir, spo2_drop, 1 from desats
        union all select rec, event_type, start_sec, end_sec, position, spo2_nadir, null, 2 from apneas
        union all select rec, event_type, start_sec, end_sec, position, spo2_nadir, null, 3 from hypopneas
        union all select rec, event_type, start_sec, end_sec, position, null, null, 4 from csr
        union all select rec, event_type, start_sec, end_sec, position, null, null, 5 from snores""",
    "cnt": """select rec, {counts} from evs group by rec""",
    "oxy": """select rec, case when count(v) > 0 then sum(v)::double / count(v) else 0 end as mean_spo2, coalesce(min(v)::double, 0) as min_spo2,
        case when count(v) > 0 then (count(case when v < 90 then 1 end) * 100)::double / count(v) else 0 end as t90,
        case when count(v) > 0 then (count(case when v < 88 then 1 end) * 100)::double / count(v) else 0 end as t88
        from (select rec, case when spo2 between 50 and 100 then spo2 end as v from slow) group by rec""",
    "sqi": """select rec, 1.0::double as sqi_flow, count(case when abs(spo2 - 127) >= 0.5 then 1 end)::double / count(*) as sqi_spo2,
        count(case when abs(pulse - 511) >= 0.5 then 1 end)::double / count(*) as sqi_pulse from slow group by rec""",
    "val": """select rec, n as seconds, n - coalesce(gone, 0) as valid_sec from tot left join (select rec, sum(e - s) as gone from excl group by rec) using (rec)""",
    "kpi0": """select v.rec, v.seconds, v.valid_sec, c.*exclude(rec), coalesce(b.n, 0) as total_ahi_events, coalesce(b.sup, 0) as sup, coalesce(b.csr, 0) as csr_sec, p.sup_sec
        from val v join (select rec, count(case when position = 4 then 1 end) as sup_sec from slow group by rec) p on p.rec = v.rec
        join cnt c on c.rec = v.rec left join (select rec, count(case when event_type in ('Obstructive', 'Central', 'Mixed', 'Unclassified', 'Hypopnea') then 1 end) as n,
        count(case when event_type in ('Obstructive', 'Central', 'Mixed', 'Unclassified', 'Hypopnea') and position = 'Supine' then 1 end) as sup,
        sum(case when event_type = 'CheyneStokes' then end_sec - start_sec else 0 end) as csr from evs group by rec) b on b.rec = v.rec""",
    "kpi": """select *, case when valid_sec > 0 then total_ahi_events / (valid_sec / 3600.0::double) else 0 end as ahi,
        case when sup_sec > 0 then sup / (sup_sec / 3600.0::double) else 0 end as ahi_supine,
        case when seconds - sup_sec > 0 then (total_ahi_events - sup) / ((seconds - sup_sec) / 3600.0::double) else 0 end as ahi_non_supine,
        case when valid_sec > 0 then desaturation_count / (valid_sec / 3600.0::double) else 0 end as odi, csr_sec / 60.0::double as csr_duration_min from kpi0""",
    "truth": """select rec, case c // 53 % 5 when 0 then 'OBSTR' when 1 then 'CNTRL' when 2 then 'MIXED' when 3 then 'HYPOP' else 'OTHER' end as t from slow where c % 53 = 0 and rec <> 7""",
    "tc": """select rec, count(case when t = 'OBSTR' then 1 end) as obstr, count(case when t = 'CNTRL' then 1 end) as cntrl, count(case when t = 'MIXED' then 1 end) as mixed,
        count(case when t = 'HYPOP' then 1 end) as hypop, count(case when t <> 'OTHER' then 1 end) as true_events from truth group by rec""",
    "cells": """select row_number() over (order by a10, h10) - 1 as cell, a10 / 10.0::double as apnea, h10 / 10.0::double as hypopnea, 1 - h10 / 10.0::double as upto
        from (select unnest(range(1, 7)) as a10), (select unnest(range(1, 8)) as h10) where h10 / 10.0::double < 1 - a10 / 10.0::double""",
    "gaf": "select rec, apnea, j, env < baseline * apnea and baseline > 1 as f from feat, (select distinct apnea from cells)",
    "gar": """select rec, apnea, count(*) as apneas from (select rec, apnea, min(j) as s, max(j) + 1 as e from
        (select rec, apnea, j, f, j - row_number() over (partition by rec, apnea, f order by j) as g from gaf) where f group by rec, apnea, g)
        join tot using (rec) where e - s >= 40 and e <= last_j group by rec, apnea""",
    "gh1": """select rec, cell, j, nx, env / baseline <= upto and env / baseline > apnea as f, o from
        (select rec, j, env, baseline, row_number() over (partition by rec order by j) as o, lead(j) over (partition by rec order by j) as nx from feat where baseline >= 1) x, cells""",
    "gh2": """select rec, cell, min(j) / 4.0::double as start_sec, arg_max(coalesce(nx, -1), j) / 4.0::double as end_sec from
        (select *, o - row_number() over (partition by rec, cell, f order by j) as g from gh1) where f group by rec, cell, g""",
    "gh3": "select * from gh2 where end_sec >= 0 and end_sec - start_sec >= 10",
    "ghk": """select distinct h.rec, h.cell, h.start_sec from gh3 h join sp s on s.rec = h.rec and s.spo2 between 50 and 100 and s.spo2_base - s.spo2 >= 3
        and s.i >= floor(h.start_sec) and s.i < floor(h.end_sec + 30)
        union select distinct h.rec, h.cell, h.start_sec from gh3 h join desats d on d.rec = h.rec and d.start_sec < h.end_sec + 30 and d.end_sec > h.start_sec""",
    "ge": """select t.rec, c.cell, c.apnea, c.hypopnea, coalesce(a.apneas, 0) as apneas, coalesce(h.n, 0) as hypopneas from tot t cross join cells c left join gar a on a.rec = t.rec and a.apnea = c.apnea
        left join (select rec, cell, count(*) as n from ghk group by rec, cell) h on h.rec = t.rec and h.cell = c.cell""",
    "gt0": """select cell, apnea, hypopnea, sum(apneas)::bigint as apneas, sum(hypopneas)::bigint as hypopneas, sum(apneas + hypopneas)::bigint as events, sum(true_events)::bigint as true_events,
        abs(sum(apneas + hypopneas) - sum(true_events))::bigint as error from ge join tc using (rec) group by cell, apnea, hypopnea""",
    "gt": "select *, error < coalesce(min(error) over (order by cell rows between unbounded preceding and 1 preceding), error + 1) as best from gt0",
    "pw1": "select rec, i as start, (i // 30) * 7 // 3 % 5 as label, row_number() over (partition by rec order by i) as o, (i // 30) % 10 / 10.0::double >= 0.3::double as ok from slow where i % 30 = 0",
    "pw2": "select rec, label as type from (select *, o - row_number() over (partition by rec, label order by start) as g from pw1 where label <> 0 and ok) group by rec, label, g",
    "px": """select t.rec, t.n / 3600.0::double as hours, coalesce(obstr, 0) as obstr, coalesce(hypop, 0) as hypop, coalesce(al, 0) / (t.n / 3600.0::double) as ahi, coalesce(cntrl, 0) as cntrl, coalesce(mixed, 0) as mixed
        from tot t left join (select rec, count(case when type = 1 then 1 end) as obstr, count(case when type = 4 then 1 end) as hypop,
        count(case when type = 2 then 1 end) as cntrl, count(case when type = 3 then 1 end) as mixed, count(*) as al from pw2 group by rec) using (rec)""",
    "cmp": """select k.rec, case when valid_sec > 0 then coalesce(true_events, 0) / (valid_sec / 3600.0::double) else 0 end as true_ahi, k.ahi as detector_ahi, p.ahi as model_ahi,
        case when k.ahi < 5 then 'Normal' when k.ahi < 15 then 'Mild' when k.ahi < 30 then 'Moderate' else 'Severe' end as osa_severity,
        coalesce(t.obstr, 0) as true_obstr, coalesce(t.cntrl, 0) as true_cntrl, coalesce(t.mixed, 0) as true_mixed, coalesce(t.hypop, 0) as true_hypop,
        p.obstr as model_obstr, p.cntrl as model_cntrl, p.mixed as model_mixed, p.hypop as model_hypop from kpi k join px p on p.rec = k.rec left join tc t on t.rec = k.rec""",
    "lw": """select rec, i as start, (i // 30) * 7 // 3 % 5 as label, split from slow join (select rec, case when r <= ceil(0.2 * n) then 'test' else 'train' end as split
        from (select rec, row_number() over (order by md5(rec::varchar || '-42')) as r, count(*) over () as n from tot)) using (rec) where i % 30 = 0""",
    "lc": "select label, count(*) as n, sum(count(*)) over () as total, count(*) over () as classes from lw group by label",
    "ln": "select *, row_number() over (partition by label order by rec, start) - 1 as number from lw",
    "bx": """select rec, j, sum(abs(flow - m)) over (partition by rec order by j rows between 20 preceding and 19 following) / 40 as env
        from flow join (select rec, avg(flow) as m from flow group by rec) using (rec)""",
    "ba": "select rec, floor((i::double + (10 + c % 20) / 2.0::double) * 4)::bigint as c from slow where c % 53 = 0 and rec <> 7 and c // 53 % 5 < 3",
}
_POS = "case p.position when 1 then 'Upright' when 2 then 'Prone' when 3 then 'Left' when 4 then 'Supine' when 5 then 'Right' else 'Unknown' end"
_THIN = """select rec, unnest(list_reduce(list_prepend([]::bigint[], list_transform(a, lambda x: [x])), lambda k, x: case when len(k) = 0 or x[1] - k[-1] >= 80 then list_concat(k, x) else k end)) as j
    from (select rec, list_sort(list(j)) as a from ext where {} group by rec)"""
_TYPES = ("Obstructive", "Central", "Mixed", "Unclassified", "Hypopnea", "Desaturation", "Snore")
_FILL = {
    "{pos}": _POS,
    "{thin_pk}": _THIN.format("pk"),
    "{thin_tr}": _THIN.format("tr"),
    "{counts}": ", ".join(f"count(case when event_type = '{x}' then 1 end) as {x.lower()}_count" for x in _TYPES),
}


def sql(query: str) -> str:
    """The query behind the expressions that it needs, in their order."""
    import re

    names, needed = list(_CTES), []
    for name in names:
        for mark, text in _FILL.items():
            _CTES[name] = _CTES[name].replace(mark, text)

    def visit(text: str) -> None:
        for name in names:
            if name not in needed and re.search(rf"\b(from|join|in \(select rec from|,)\s+{name}\b", text):
                visit(_CTES[name])
                needed.append(name)

    visit(query)
    return "with " + ",\n".join(f"{x} as ({_CTES[x]})" for x in needed) + "\n" + query if needed else query


def oracle_sql() -> dict[str, str]:
    iou = "greatest(least(a.e, b.e) - greatest(a.s, b.s), 0)"
    logits = "list_transform(embedding[1:5], lambda x: x::double)"
    out = {
        "signal_view": "select rec, i, c, effort, spo2, pulse, position from slow",
        "flow_view": "select rec, j, flow from flow",
        "envelope": "select rec, j, env from env",
        "downsample_max": "select rec, i, env from down",
        "baseline_percentile": "select rec, i, baseline from pct",
        "baseline_upsample": "select rec, j, baseline from feat",
        "spo2_baseline": "select rec, i, spo2_base from sp",
        "sentinel_segments": "select rec, s as start_sec, e as end_sec from sent",
        "excluded_merged": "select rec, s as start_sec, e as end_sec from excl",
        "sqi": "select rec, sqi_flow, sqi_spo2, sqi_pulse from sqi",
        "valid_duration": "select rec, seconds, valid_sec::bigint as valid_sec from val",
        "apnea_runs": "select rec, start_sec, end_sec from apr",
        "apnea_classified": "select rec, start_sec, end_sec, event_type from apc",
        "apnea_nadir_position": "select rec, event_type, start_sec, end_sec, position, spo2_nadir from apneas",
        "desaturation": "select rec, start_sec, end_sec, position, spo2_nadir, spo2_drop from desats",
        "hypopnea": "select rec, start_sec, end_sec, position, spo2_nadir from hypopneas",
        "csr_peaks": "select rec, j from peaks",
        "csr_troughs": "select rec, j from troughs",
        "csr_segments": "select rec, start_sec, end_sec, position from csr",
        "snore_windows": "select rec, w, round(hf_ratio, 9) as hf_ratio, zcr, round(rms, 9) as rms, snoring from snw",
        "snore_events": "select rec, start_sec, end_sec, position from snores",
        "all_events": "select rec, event_type, start_sec, end_sec, position, spo2_nadir, spo2_drop from evs",
        "event_counts": "select rec, " + ", ".join(f"{x.lower()}_count" for x in _TYPES) + " from cnt",
        "oxygen_metrics": "select rec, mean_spo2, min_spo2, t90, t88 from oxy",
        "position_minutes": f"select rec, {_POS} as position, count(*) / 60.0::double as minutes from slow p group by all",
        "kpi_indices": "select rec, ahi, ahi_supine, ahi_non_supine, odi, csr_duration_min from kpi",
        "severity": """select rec, ahi, case when ahi < 5 then 'Normal' when ahi < 15 then 'Mild' when ahi < 30 then 'Moderate' else 'Severe' end as osa_severity,
            ahi_non_supine > 0 and coalesce(ahi_supine / nullif(ahi_non_supine, 0) > 2, false) as positional_osa from kpi""",
        "clinical_report": "select k.rec, k.seconds, k.valid_sec::bigint as valid_sec, k.total_ahi_events, k.desaturation_count, k.ahi, k.odi, o.mean_spo2, o.min_spo2, o.t90, o.t88 from kpi k join oxy o on o.rec = k.rec",
        "resample_grid": """select rec, g, round(b + (nb - b) * (x - floor(x)), 9) as value from (select rec, g, g / 2.5::double as x from (select rec, n, unnest(range(0, 3 * n)) as g from tot) where 2 * g < 5 * (n - 1)) q
            join (select rec as r2, i, spo2::double as b, coalesce(lead(spo2) over (partition by rec order by i), spo2)::double as nb from slow) k on k.r2 = q.rec and k.i = floor(x)""",
        "norm_stats": """select channel, round(avg(v), 9) as mean, round(stddev_pop(v), 9) as std from (select 'effort' as channel, effort as v from slow
            union all select 'pulse', pulse from slow union all select 'spo2', spo2 from slow) group by channel""",
        "zscore": "select rec, i, round((spo2 - m) / (sd + 1e-9), 6) as z from slow, (select avg(spo2) as m, stddev_pop(spo2) as sd from slow)",
        "derived_channels": """select rec, i, spo2 - coalesce(lag(spo2) over (partition by rec order by i), spo2) as spo2_deriv,
            round(least(greatest(abs(effort) / (abs(amp) + 1e-6), 0), 10), 9) as effort_ratio from slow""",
        "model_windows": """select t.rec, w.s as start, sum(x.spo2)::bigint as spo2_sum, count(*) as n from (select rec, n, unnest(range(0, n, 30)) as s from tot) w join tot t on t.rec = w.rec
            join slow x on x.i >= w.s and x.i < w.s + 60 where x.rec = t.rec and w.s < t.n - 60 group by t.rec, w.s""",
        "event_windows": """select a.rec, a.start_sec, sum(x.spo2)::bigint as spo2_sum, count(*) as n from (select rec, start_sec, floor(start_sec + (end_sec - start_sec) / 2)::bigint as c from apr) a
            join tot t on t.rec = a.rec join slow x on x.rec = a.rec and x.i >= a.c - 30 and x.i < a.c + 30 where a.c - 30 >= 0 and a.c + 30 < t.n group by a.rec, a.start_sec""",
        "class_weights": """select label, n, round(w / sum(w) over () * count(*) over (), 9) as weight from (select label, count(*) as n, 1 / (sqrt(count(*)) + 1) * case when label > 0 then 2 else 1 end as w from embeddings group by label)""",
        "argmax_windows": f"select vec_id, list_position(a, list_max(a)) - 1 as label, list_max(a) as top from (select vec_id, {logits} as a from embeddings)",
        "softmax_windows": f"""select vec_id, k - 1 as k, round(exp(a[k] - list_max(a)) / list_sum(list_transform(a, lambda x: exp(x - list_max(a)))), 9) as p
            from (select vec_id, {logits} as a from embeddings), (select unnest([1, 2, 3, 4, 5]) as k)""",
        "topk_experts": """select vec_id, k - 1 as expert, rn as place from (select vec_id, k, row_number() over (partition by vec_id order by embedding[k] desc, k) as rn from embeddings, (select unnest(range(1, 9)) as k)) where rn <= 2""",
        "runlength_events": "select rec, type, start, \"end\", avg_conf, n from rl",
        "iou_pairs": f"""select a.rec, a.s as s1, b.s as s2, {iou} / ((a.e - a.s) + (b.e - b.s) - {iou}) as iou from (select rec, start_sec as s, end_sec as e from csr) a
            join (select rec, start_sec as s, end_sec as e from desats) b on a.rec = b.rec and a.s < b.e and b.s < a.e""",
        "desat_gate": """select h.rec, h.start_sec, max(case when s.i < floor(h.start_sec) + 10 then s.spo2 end)::bigint as base, min(case when s.i >= floor(h.start_sec) then s.spo2 end)::bigint as nadir
            from hypopneas h join slow s on s.rec = h.rec and s.i >= greatest(floor(h.start_sec) - 30, 0) and s.i < floor(h.end_sec) + 30 group by h.rec, h.start_sec
            having max(case when s.i < floor(h.start_sec) + 10 then s.spo2 end) - min(case when s.i >= floor(h.start_sec) then s.spo2 end) >= 2""",
        "confusion": "select quality as truth, toxic as predicted, count(*) as n from labels group by quality, toxic",
        "classification_report": """select c as label, coalesce(tp::double / nullif(pr, 0), 0) as precision, coalesce(tp::double / nullif(su, 0), 0) as recall,
            coalesce(2.0::double * tp / nullif(pr + su, 0), 0) as f1, su as support from (select c, count(case when quality = c and toxic = c then 1 end) as tp,
            count(case when toxic = c then 1 end) as pr, count(case when quality = c then 1 end) as su from labels, (select unnest([0, 1]) as c) group by c)""",
        "ahi_mae": "select count(*) as recordings, round(avg(abs(ahi - true_events / (valid_sec / 3600.0::double))), 9) as mae, round(max(abs(ahi - true_events / (valid_sec / 3600.0::double))), 9) as worst from kpi k join tc using (rec)",
        "edf_roundtrip": "select rec, 'SaO2' as label, i, spo2::double as value from slow union all select rec, 'Resp thorax', i, effort::double from slow",
        "config_version": """select rec, substr(md5('{"rec":' || rec || ',"n":' || n || '}'), 1, 8) as version from tot""",
        "alignment_check": """select rec, events, round(q / (m + 1e-9), 6) as ratio, case when q / (m + 1e-9) < 0.7 then 'OK' else 'MISMATCH' end as verdict from (select rec, median(env) as m from bx group by rec)
            join (select b.rec, count(*) as events, median(env) as q from bx b join ba a on a.rec = b.rec and a.c = b.j join tot t on t.rec = b.rec where b.j >= 40 and b.j < t.last_j + 1 - 40 group by b.rec) using (rec)""",
        "balanced_batches": """select batch, label, place, rec, start from (select label, n, batch, unnest(range(0, 64 // classes)) as place from
            (select label, n, classes, unnest(range(0, (total // 64)::bigint)) as batch from lc)) join ln using (label)
            where number = ('0x' || substr(md5('42-0-' || batch || '-' || label || '-' || place), 1, 8))::bigint % n""",
        "dataset_roundtrip": """select w.rec, w.start, w.split, w.label, sum(x.spo2)::bigint as spo2, sum(x.effort)::bigint as effort, sum(x.pulse)::bigint as pulse from lw w join tot t on t.rec = w.rec
            join slow x on x.rec = w.rec and x.i >= w.start and x.i < w.start + 60 where w.start < t.n - 60 group by w.rec, w.start, w.split, w.label""",
        "class_histogram": """select label, n, round(w / sum(w) over () * 5, 9) as weight from (select k as label, count(x) as n, 1 / (sqrt(count(x)) + 1) * case when k > 0 then 2 else 1 end as w
            from (select unnest(range(0, 5)) as k) left join (select label as x from lw where label <> 3) on x = k group by k)""",
        "grid_events": "select rec, cell, apnea, hypopnea, apneas, hypopneas from ge",
        "grid_totals": "select cell, printf('v1.0-A%.1f-H%.1f', apnea, hypopnea) as version, apnea, hypopnea, apneas, hypopneas, events, true_events, error, best from gt",
        "grid_argmin": "select apnea, hypopnea, apneas, hypopneas, events, error from (select *, row_number() over (order by error, cell) as r from gt) where r = 1",
        "truth_counts": "select rec, obstr, cntrl, mixed, hypop, true_events from tc",
        "model_errors": "select rec, round(true_events / hours, 9) as true_ahi, round(ahi, 9) as ahi, round(abs(ahi - true_events / hours), 9) as error from px join (select rec, true_events from tc) using (rec)",
        "comparison": """select rec, round(true_ahi, 9) as true_ahi, round(detector_ahi, 9) as detector_ahi, round(model_ahi, 9) as model_ahi, osa_severity,
            case when true_ahi < 5 then 'Normal' when true_ahi < 15 then 'Mild' when true_ahi < 30 then 'Moderate' else 'Severe' end as true_severity, true_obstr, true_hypop, model_obstr, model_hypop from cmp""",
        "comparison_report": """select section, rec, line_no, line from (values (0, null::bigint, 0, '# Comparison of labels, detector and network'), (0, null, 1, ''), (0, null, 2, '## Index (events per hour)'),
            (0, null, 3, '| Patient | Labels | Detector | Network | Severity |'), (0, null, 4, '|-|-|-|-|-|'), (1, null, 0, ''), (1, null, 1, '## Events by class'),
            (1, null, 2, '| Patient | Class | Labels | Network |'), (1, null, 3, '|-|-|-|-|')) h(section, rec, line_no, line)
            union all select 0, rec, 0, printf('| patient_%03d | **%.2f** | %.2f | %.2f | %s |', rec, true_ahi, detector_ahi, model_ahi, osa_severity) from cmp
            union all select 1, rec, k, printf('| patient_%03d | %s | %d | %d |', rec, name, own, model) from (select rec, unnest([0, 1, 2, 3]) as k, unnest(['Obstructive', 'Central', 'Mixed', 'Hypopnea']) as name,
            unnest([true_obstr, true_cntrl, true_mixed, true_hypop]) as own, unnest([model_obstr, model_cntrl, model_mixed, model_hypop]) as model from cmp)""",
        "duplicates": "select md5(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by text having count(*) > 1",
        "patient_split": "select rec, case when r <= ceil(0.2 * n) then 'test' else 'train' end as split from (select rec, row_number() over (order by md5(rec::varchar || '-42')) as r, count(*) over () as n from tot)",
        "grid_search": """select a10 / 10.0::double as apnea, h10 / 10.0::double as hypopnea, count(case when r < a10 / 10.0::double then 1 end) as below,
            count(case when r <= 1 - h10 / 10.0::double and r > a10 / 10.0::double then 1 end) as between_n
            from (select env / baseline as r from feat where baseline >= 1), (select unnest(range(1, 7)) as a10), (select unnest(range(1, 8)) as h10)
            where h10 / 10.0::double < 1 - a10 / 10.0::double group by a10, h10""",
        "alignment_ratio": "select rec, round(q.m / t.m, 9) as ratio from (select rec, median(env) as m from feat f where exists (select 1 from apr a where a.rec = f.rec and f.j >= a.start_sec * 4 and f.j < a.end_sec * 4) group by rec) q join (select rec, median(env) as m from feat group by rec) t using (rec)",
        "split_long": """select rec, part, start_sec + part * len / n as start_sec, start_sec + (part + 1) * len / n as end_sec from (select rec, start_sec, end_sec - start_sec as len,
            case when end_sec - start_sec > 12 then floor((end_sec - start_sec) / 6)::bigint else 1 end as n from hypopneas), (select unnest(range(0, 200)) as part) where part < n""",
        "confusion_dense": """select t as truth, p as predicted, count(quality) as n from (select unnest([0, 1, 2]) as t), (select unnest([0, 1, 2]) as p)
            left join labels on quality = t and toxic = p group by t, p""",
        "report_averages": """select round(sum(tp) / sum(su), 9) as accuracy, round(avg(pc), 9) as macro_precision, round(avg(rc), 9) as macro_recall, round(avg(f), 9) as macro_f1,
            round(sum(pc * su) / sum(su), 9) as weighted_precision, round(sum(rc * su) / sum(su), 9) as weighted_recall, round(sum(f * su) / sum(su), 9) as weighted_f1, sum(su)::bigint as support
            from (select tp, su, coalesce(tp::double / nullif(pr, 0), 0) as pc, coalesce(tp::double / nullif(su, 0), 0) as rc, coalesce(2.0::double * tp / nullif(pr + su, 0), 0) as f
            from (select c, count(case when quality = c and toxic = c then 1 end) as tp, count(case when toxic = c then 1 end) as pr,
            count(case when quality = c then 1 end) as su from labels, (select unnest([0, 1]) as c) group by c))""",
        "stream_sliding": """select rec, w.s as window_start, count(*) as n, sum(c)::bigint as total from (select user_id % 8 as rec, floor(epoch(ts))::bigint as t, cast(round(value * 100) as bigint) as c from events) e,
            (select unnest([0, 30]) as back) b, lateral (select (e.t // 30) * 30 - b.back as s) w group by rec, w.s""",
    }
    extra = {
        "runlength_events": """rl0 as (select user_id % 8 as rec, row_number() over (partition by user_id % 8 order by ts, event_id) - 1 as i, (event_id * 7 // 3) % 3 as label, (event_id % 10) / 10.0::double as conf from events),
            rl1 as (select rec, i * 30 as start, label, conf, label != 0 and conf >= 0.3::double as ok from rl0),
            rl2 as (select *, row_number() over (partition by rec order by start) as o from rl1),
            rl3 as (select *, o - row_number() over (partition by rec, label order by start) as g from rl2 where ok),
            rl as (select rec, label as type, min(start) as start, (max(start) + 60)::double as "end", round(avg(conf), 9) as avg_conf, count(*) as n from rl3 group by rec, label, g)""",
    }
    done = {}
    for name, query in out.items():
        if name in extra:
            inner = sql("select * from slow") if "slow" in extra[name] else ""
            lead = inner.rsplit("\nselect * from slow", 1)[0] + ",\n" if inner else "with "
            done[name] = lead + extra[name] + "\n" + query
        else:
            done[name] = sql(query)
    return done
