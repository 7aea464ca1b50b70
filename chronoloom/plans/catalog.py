"""Named queries over a folder of tables, and the SQL (for another engine) that each must equal.

Tracks come from the event table (``sources.timeline``). The SQL is written on its own, from the operators' definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK
from chronoloom.operators import curve, documents, merge, modes, shell, stats, structure, tempo, timeline
from chronoloom.sources.timeline import canonical_beats, load_beats, resolve_chapters

FLAGSHIP = "generate_default"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            needed: list[str] = []
            for p in parts:
                _need(p, needed)
            heads = ",\n".join(CTE[p] for p in needed)
            ORACLE_SQL[f.__name__] = (f"with recursive {heads}\n" if heads else "") + sql
        return f

    return add


def _need(name: str, out: list[str]) -> None:
    for other in DEPENDS.get(name, ()):
        _need(other, out)
    if name not in out:
        out.append(name)


RANK = "list_sort(list({x}))[cast(least(count({x}) - 1, floor(count({x}) * {q}e0)) as int) + 1]"
RANK_B = "list_sort(list({x}))[cast(least(count({x}) - 1, round_even((count({x}) - 1) * {q}e0, 0)) as int) + 1]"
FIVE_B = ", ".join(RANK_B.format(x="energy", q=q / 100) + f" as p{q}" for q in (5, 25, 50, 75, 95))
DEPENDS = {
    "steps": ("beats",), "stanzas": ("beats",), "chunks": ("beats",), "trend": ("beats", "stanzas"), "modes": ("beats", "stanzas", "trend"), "nd": ("beats",), "arcs": ("beats",), "fire": ("arcs",), "profile": ("steps",), "norms": ("beats",),
    "moded": ("nd", "modes", "norms"), "fixed": ("moded",), "tone": ("beats", "stanzas"), "bpms": ("beats",), "astanzas": ("beats",), "vel": ("steps",), "chapters": ("talks",), "placed": ("stanzas", "chunks"),
}
CTE = {
    "beats": """beats as (
        select track_id, cast(row_number() over (partition by track_id order by ms, event_id) - 1 as int) as seq, (ms - m0) // 60000 as at_ms,
            case when mx > 0 then floor(value / mx * 1024) / 1024 else 0 end as energy, cast(least(100, greatest(0, floor(value))) as int) as pos, event_id, event_type, props
        from (select *, min(ms) over (partition by track_id) as m0, max(value) over (partition by track_id) as mx
            from (select user_id as track_id, event_id, epoch_ms(ts) as ms, value, event_type, props from events)))""",
    "steps": "steps as (select *, abs(pos - lag(pos) over w) as stroke, at_ms - lag(at_ms) over w as dt from beats window w as (partition by track_id order by at_ms, seq))",
    "vel": "vel as (select track_id, seq, at_ms, stroke / dt * 1000 as velocity from steps where dt > 0)",
    "stanzas": """stanzas as (select track_id, cast(seq // 16 as int) as stanza_idx, min(at_ms) as start_ms,
        coalesce(lead(min(at_ms)) over (partition by track_id order by seq // 16), max(max(at_ms)) over (partition by track_id)) as end_ms from beats group by track_id, seq // 16)""",
    "astanzas": """astanzas as (select track_id, cast(seq // 16 as int) as stanza_idx, min(at_ms) as start_ms,
        coalesce(lead(min(at_ms)) over (partition by track_id order by seq // 16), max(at_ms) + 1) as end_ms from beats group by track_id, seq // 16)""",
    "chunks": """chunks as (select track_id, cast(i as int) as chunk_idx, i * 15000 as at_ms, case when i = n - 1 then d else (i + 1) * 15000 end as end_ms from (
        select track_id, d, n, unnest(range(n)) as i from (select track_id, d, case when k > 1 and d - (k - 1) * 15000 < 7500 then k - 1 else k end as n
            from (select track_id, max(at_ms) as d, greatest(1, (max(at_ms) + 14999) // 15000) as k from beats group by track_id))))""",
    "trend": """trend as (select track_id, stanza_idx, count(*) as n_beats, avg(energy) as avg_energy,
        coalesce(avg(energy) filter (k >= n // 2) - avg(energy) filter (k < n // 2), 0) as trend, avg(energy) filter (k >= n // 2) as second_avg from (
            select b.track_id, s.stanza_idx, b.energy, row_number() over (partition by b.track_id, s.stanza_idx order by b.seq) - 1 as k, count(*) over (partition by b.track_id, s.stanza_idx) as n
            from beats b join stanzas s on b.track_id = s.track_id and b.at_ms >= s.start_ms and b.at_ms < s.end_ms) group by track_id, stanza_idx)""",
    "modes": f"""modes as (select d.track_id, d.stanza_idx, d.start_ms, d.end_ms, case when d.n_beats is null or d.avg_energy < greatest(q.p15, 0.08e0) then 'break'
            when d.trend >= 0.15e0 and d.second_avg >= q.p50 then 'edging' when m.med > 0 and d.density >= m.med * 1.25e0 then 'fast'
            when m.med > 0 and d.density <= m.med * 0.75e0 then 'slow' when d.avg_energy < q.p40 then 'tease' else 'steady' end as mode
        from (select s.*, t.n_beats, t.avg_energy, t.trend, t.second_avg, coalesce(t.n_beats, 0) / greatest(1e-6, (s.end_ms - s.start_ms) / 1000e0) as density from stanzas s left join trend t using (track_id, stanza_idx)) d
        join (select track_id, {RANK.format(x="energy", q=0.15)} as p15, {RANK.format(x="energy", q=0.4)} as p40, {RANK.format(x="energy", q=0.5)} as p50 from beats group by track_id) q on d.track_id = q.track_id
        left join (select track_id, {RANK.format(x="density", q=0.5)} as med from (select s.track_id, t.n_beats / greatest(1e-6, (s.end_ms - s.start_ms) / 1000e0) as density from stanzas s join trend t using (track_id, stanza_idx)) group by track_id) m on d.track_id = m.track_id)""",
    "nd": """nd as (select g.*, coalesce(gap, m, 480) as dur_ms from (select *, lead(at_ms) over (partition by track_id order by at_ms, seq) - at_ms as gap from beats) g
        left join (select track_id, list_sort(list(gap))[count(gap) // 2 + 1] as m from (select track_id, lead(at_ms) over (partition by track_id order by at_ms, seq) - at_ms as gap from beats) where gap is not null group by track_id) x on g.track_id = x.track_id)""",
    "norms": f"""norms as (select b.track_id, b.seq, case when r.ref > 0 then least(1.0e0, b.energy / r.ref) else b.energy end as norm from beats b
        join (select track_id, case when a = 0 then m else a end as ref from (select track_id, {RANK.format(x="energy", q=0.95)} as a, max(energy) as m from beats group by track_id)) r using (track_id))""",
    "arcs": """arcs as (select track_id, seq, at_ms, energy, greatest(0, least(1, case when p < 0.08e0 then 0e0 + (0.5e0 - 0e0) * (p / 0.08e0)
            when p > 1e0 - 0.12e0 then 0e0 + (0.5e0 - 0e0) * ((1e0 - p) / 0.12e0)
            when p >= 0.85e0 - 0.09e0 and p <= 0.85e0 + 0.09e0 then 0.5e0 + (0.72e0 - 0.5e0) * (1e0 - abs(p - 0.85e0) / 0.09e0) else 0.5e0 end)) as arc
        from (select *, greatest(0, least(1, (at_ms - min(at_ms) over w) / case when max(at_ms) over w = min(at_ms) over w then 1 else max(at_ms) over w - min(at_ms) over w end)) as p from beats window w as (partition by track_id)))""",
    "fire": """fire as (select track_id, seq, least(1e0, arc / 0.45e0) as acc from arcs where seq = 0
        union all select a.track_id, a.seq, case when f.acc < 1 then f.acc else f.acc - 1 end + least(1e0, a.arc / 0.45e0) from fire f join arcs a on a.track_id = f.track_id and a.seq = f.seq + 1)""",
    "moded": """moded as (select n.track_id, n.seq, n.at_ms, n.energy, n.dur_ms, x.norm, coalesce(h.mode, l.mode) as mode from nd n join norms x using (track_id, seq)
        left join (select b.track_id, b.seq, arg_min(m.mode, m.stanza_idx) as mode from beats b join modes m on b.track_id = m.track_id and b.at_ms >= m.start_ms and b.at_ms < m.end_ms group by all) h on n.track_id = h.track_id and n.seq = h.seq
        left join (select track_id, arg_max(mode, stanza_idx) as mode from modes group by track_id) l on n.track_id = l.track_id)""",
    "fixed": """fixed as (select *, 50e0 * case mode when 'break' then 0.55e0 when 'tease' then 0.72e0 when 'slow' then 0.95e0 when 'fast' then 0.5e0 else 1e0 end as half,
        case mode when 'fast' then 4 when 'edging' then 6 else 2 end as strokes from moded)""",
    "tone": """tone as (select s.track_id, s.stanza_idx, s.start_ms, s.end_ms, 50 - d as start_center, 50 + d as end_center from stanzas s join (
        select s.track_id, s.stanza_idx, cast(coalesce(case when g.n >= 2 then round_even(greatest(-1e0, least(1e0, (sie - (n - 1) / 2e0 * se) / (n * (n * n - 1) / 12e0) * (n - 1))) * 20 / 2, 0) else 0 end, 0) as int) as d
        from stanzas s left join (select track_id, stanza_idx, count(*) as n, sum(energy) as se, sum(i * energy) as sie from (
            select b.track_id, s.stanza_idx, b.energy, row_number() over (partition by b.track_id, s.stanza_idx order by b.seq) - 1 as i from beats b join stanzas s on b.track_id = s.track_id and b.at_ms >= s.start_ms and b.at_ms < s.end_ms) group by all) g
            using (track_id, stanza_idx)) x using (track_id, stanza_idx))""",
    "bpms": """bpms as (select t.track_id, coalesce(case when g > 0 then 60000e0 / g end, 0) as bpm from (select distinct track_id from beats) t left join (
        select track_id, list_sort(list(gap))[count(gap) // 2 + 1] as g from (select track_id, at_ms - lag(at_ms) over (partition by track_id order by at_ms, seq) as gap from beats) where gap is not null group by track_id) using (track_id))""",
    "profile": """profile as (select f.track_id, f.w as "window", f.t0 + f.w * f.width as at_ms, coalesce(c, 0) as n,
            case when coalesce(c, 0) < 2 then 0 else c / case when a = b then 1e0 else (b - a) / 1000 end end as rate, case when coalesce(c, 0) < 2 then 0 else rails * 100 // c end as rails_pct,
            case when coalesce(c, 0) < 2 then 0 else mid * 100 // c end as mid_pct, case when coalesce(c, 0) < 2 then 0 else stroke end as avg_stroke,
            case when coalesce(c, 0) < 2 then 0 else mean_pos end as mean_pos, case when coalesce(c, 0) < 2 or nv = 0 then 0 else sv / nv end as avg_velocity
        from (select track_id, t0, width, cast(unnest(range(12)) as int) as w from (select track_id, min(at_ms) as t0, greatest(1, (max(at_ms) - min(at_ms)) // 12) as width from steps group by track_id having count(*) >= 2)) f
        left join (select track_id, w, count(*) as c, min(at_ms) as a, max(at_ms) as b, count(*) filter (d in (0, 9)) as rails, count(*) filter (d between 2 and 7) as mid, avg(stroke) filter (same) as stroke, avg(pos) as mean_pos,
                count(v) as nv, list_reduce(list(coalesce(v, 0) order by seq), lambda p, q: p + q) as sv
            from (select *, least(9, pos // 10) as d, case when dt > 0 then stroke / dt * 1000 end as v, lag(w) over (partition by track_id order by at_ms, seq) = w as same from (
                select *, (at_ms - min(at_ms) over t) // greatest(1, (max(at_ms) over t - min(at_ms) over t) // 12) as w from steps window t as (partition by track_id))) where w < 12 group by track_id, w) g on f.track_id = g.track_id and f.w = g.w)""",
    "talks": """talks as (select conv_id as track_id, cast(turn as int) as seq, turn * 12000 as at_ms, text as name, role as intent from conversations)""",
    "chapters": "chapters as (select *, cast(null as bigint) as end_ms from talks)",
    "placed": """placed as (select s.track_id, s.stanza_idx, s.start_ms, s.end_ms, coalesce(min(c.chunk_idx), max(l.last)) as chapter_idx from stanzas s
        left join chunks c on s.track_id = c.track_id and (s.start_ms + s.end_ms) // 2 >= c.at_ms and (s.start_ms + s.end_ms) // 2 < c.end_ms
        join (select track_id, max(chunk_idx) as last from chunks group by track_id) l on s.track_id = l.track_id group by all)""",
}


FOLD = """f{j} as (select track_id, cast(case when fold then seq // 2 else seq end as int) as seq, at_ms, energy, case when fold then bpm / 2 else bpm end as bpm from (
    select *, bpm > 165 and bpm / 2 >= 70 and count(*) over w >= 4 as fold, case when sum(case when seq % 2 = 0 then energy else 0 end) over w >= sum(case when seq % 2 = 1 then energy else 0 end) over w then 0 else 1 end as keep
    from f{i} window w as (partition by track_id)) where not fold or seq % 2 = keep)"""
CTE["b"] = "b as (select track_id, seq, cast(seq * 1000 as varchar) as at_ms, energy, pos from beats)"
DEPENDS["b"] = ("beats",)
CTE["fold"] = "f0 as (select b.track_id, b.seq, b.at_ms, b.energy, t.bpm from beats b join bpms t using (track_id)),\n" + ",\n".join(FOLD.format(i=i, j=i + 1) for i in range(9))
DEPENDS["fold"] = ("bpms",)
CTE["lift"] = """x as (select b.*, t.bpm * 0.75e0 as bpm, lead(at_ms) over w as nxt, lead(energy) over w as ne, t.bpm > 0 and count(*) over (partition by b.track_id) >= 4 and t.bpm * 0.75e0 * 2 <= 165 and t.bpm * 1.99e0 / (t.bpm * 0.75e0) between 1.7e0 and 2.3e0 as lift
    from beats b join bpms t using (track_id) window w as (partition by b.track_id order by at_ms, seq))"""
DEPENDS["lift"] = ("bpms",)
CTE["cuts"] = "cuts as (select distinct track_id, cut from (select track_id, at_ms / 1000 as cut from beats where energy > 0.7 union all select track_id, 0 from beats union all select track_id, max(at_ms) / 1000 from beats group by track_id))"
DEPENDS["cuts"] = ("beats",)
CTE["kept"] = """r as (select *, row_number() over (partition by track_id order by cut) as i, count(*) over (partition by track_id) as n from cuts),
    kept as (select track_id, i, n, cut, cut as last, true as keep from r where i = 1
        union all select r.track_id, r.i, r.n, r.cut, case when r.i < r.n and r.cut - k.last >= 3 then r.cut else k.last end, r.i < r.n and r.cut - k.last >= 3 from kept k join r on r.track_id = k.track_id and r.i = k.i + 1)"""
DEPENDS["kept"] = ("cuts",)
CTE["micro"] = """micro as (select track_id, cut from (select k.*, e.c as final, max(case when keep then i end) over (partition by k.track_id) as top, max(case when keep then cut end) over (partition by k.track_id) as lastkept, count(*) filter (keep) over (partition by k.track_id) as nk
        from kept k join (select track_id, max(cut) as c from cuts group by track_id) e on k.track_id = e.track_id)
    where i = n or (keep and (n <= 2 or not (i = top and nk >= 2 and final - lastkept < 3))))"""
DEPENDS["micro"] = ("kept",)


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_beats(spark, sf_dir)


def _chunks(beats: DataFrame) -> DataFrame:
    return timeline.time_chunks(timeline.durations(beats))


def _chapters(beats: DataFrame) -> DataFrame:
    return _chunks(beats).withColumnRenamed("chunk_idx", "chapter_idx")


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chapter lists: a turn every 12 s."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select(F.col("conv_id").alias(TRACK), F.col("turn").cast("int").alias("seq"), (F.col("turn") * 12_000).alias("at_ms"), F.col("text").alias("name"), F.col("role").alias("intent"), F.lit(None).cast("long").alias("end_ms"))


@query("select track_id, seq, at_ms, energy, pos from beats", "beats")
def canonical_beats_(spark, sf_dir):
    return _beats(spark, sf_dir)


@query("select track_id, cast(count(*) filter (d = 0) as bigint) d0, " + ", ".join(f"count(*) filter (d = {i}) d{i}" for i in range(1, 10)) + " from (select track_id, least(9, pos // 10) as d from beats) group by track_id", "beats")
def decile_histogram(spark, sf_dir):
    return stats.decile_histogram(_beats(spark, sf_dir))


POSITION = f"""select *, p75 - p25 as iqr, rails_pct > mid_pct as bimodal from (select track_id, count(*) as n, count(*) filter (pos // 10 in (0, 9, 10)) * 100 // count(*) as rails_pct,
    count(*) filter (pos // 10 in (1, 8)) * 100 // count(*) as limbo_pct, count(*) filter (pos // 10 between 2 and 7) * 100 // count(*) as mid_pct,
    {", ".join(RANK.format(x="pos", q=q / 100) + f" as p{q}" for q in (5, 25, 50, 75, 95))} from beats group by track_id)"""


@query(POSITION, "beats")
def position_stats(spark, sf_dir):
    return stats.position_stats(_beats(spark, sf_dir))


@query("select * from vel", "vel")
def velocities(spark, sf_dir):
    return stats.velocities(_beats(spark, sf_dir))


MOTION = f"""select track_id, n, case when n < 2 then 0 else n / case when duration_ms = 0 then 1e0 else duration_ms / 1000 end end as rate, coalesce(avg_stroke, 0) as avg_stroke, coalesce(avg_velocity, 0) as avg_velocity,
    coalesce(p50_velocity, 0) as p50_velocity, coalesce(p90_velocity, 0) as p90_velocity, duration_ms
    from (select track_id, count(*) as n, max(at_ms) - min(at_ms) as duration_ms, avg(stroke) as avg_stroke from steps group by track_id)
    left join (select track_id, list_reduce(list(velocity order by seq), lambda a, b: a + b) / count(*) as avg_velocity, {RANK.format(x="velocity", q=0.5)} as p50_velocity, {RANK.format(x="velocity", q=0.9)} as p90_velocity from vel group by track_id) using (track_id)"""


@query(MOTION, "vel")
def motion_stats(spark, sf_dir):
    return stats.motion_stats(_beats(spark, sf_dir))


SPEED = """select t.track_id, coalesce(n, 0) as n, coalesce(very_slow, 0) as very_slow, coalesce(slow, 0) as slow, coalesce(medium, 0) as medium, coalesce(fast, 0) as fast, coalesce(very_fast, 0) as very_fast,
    coalesce(ultra_fast, 0) as ultra_fast, coalesce(flash, 0) as flash from (select distinct track_id from beats) t left join (select track_id, count(*) as n, count(*) filter (velocity < 50) as very_slow,
    count(*) filter (velocity >= 50 and velocity < 150) as slow, count(*) filter (velocity >= 150 and velocity < 250) as medium, count(*) filter (velocity >= 250 and velocity < 350) as fast,
    count(*) filter (velocity >= 350 and velocity < 450) as very_fast, count(*) filter (velocity >= 450 and velocity < 600) as ultra_fast, count(*) filter (velocity >= 600) as flash from vel group by track_id) using (track_id)"""


@query(SPEED, "vel")
def speed_distribution(spark, sf_dir):
    return stats.speed_distribution(_beats(spark, sf_dir))


@query("select * from profile", "profile")
def windowed_profile(spark, sf_dir):
    return stats.windowed_profile(_beats(spark, sf_dir))


def _cov_sql(x: str) -> str:
    return f'case when m_{x} = 0 then 0 else sqrt(list_reduce(list_transform(l_{x}, lambda v: (v - m_{x}) * (v - m_{x})), lambda a, b: a + b) / 12) / m_{x} end'


DYNAMICS = f"""select track_id, {_cov_sql("v")} as velocity_cov, {_cov_sql("r")} as rate_cov from (select track_id, list(avg_velocity order by "window") as l_v, list(rate order by "window") as l_r,
    list_reduce(list(avg_velocity order by "window"), lambda a, b: a + b) / 12 as m_v, list_reduce(list(rate order by "window"), lambda a, b: a + b) / 12 as m_r from profile group by track_id)"""


@query(DYNAMICS, "profile")
def dynamics_index(spark, sf_dir):
    return stats.dynamics_index(stats.windowed_profile(_beats(spark, sf_dir)))


@query(f"select * from ({POSITION}) join (select * exclude (n) from ({MOTION})) using (track_id) join (select * rename (n as n_velocities) from ({SPEED})) using (track_id) join ({DYNAMICS}) using (track_id)", "vel", "profile")
def summarize(spark, sf_dir):
    return stats.summarize(_beats(spark, sf_dir))


@query("select track_id, seq, at_ms, energy, pos from beats where at_ms >= 5000 and at_ms < 20000", "beats")
def beats_in_range(spark, sf_dir):
    return timeline.beats_in_range(_beats(spark, sf_dir), 5000, 20_000)


@query("select track_id, seq, at_ms from beats where seq % 4 = 0", "beats")
def downbeats(spark, sf_dir):
    return timeline.downbeats(_beats(spark, sf_dir))


@query("select * from stanzas", "stanzas")
def stanzas_16(spark, sf_dir):
    return timeline.stanzas(_beats(spark, sf_dir))


@query("select * from astanzas", "astanzas")
def action_stanzas(spark, sf_dir):
    return timeline.action_stanzas(_beats(spark, sf_dir))


@query("select track_id, seq, at_ms, energy, pos, dur_ms from nd", "nd")
def next_dur(spark, sf_dir):
    return timeline.next_durations(_beats(spark, sf_dir))


@query("select * from chunks", "chunks")
def time_chunks(spark, sf_dir):
    return _chunks(_beats(spark, sf_dir))


def _probes(beats: DataFrame) -> DataFrame:
    return timeline.durations(beats).select(TRACK, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("probe_id")).select(TRACK, "probe_id", (F.col("probe_id") * 5001 - 500).alias("at_ms"))


PROBES = """select p.track_id, p.probe_id, p.at_ms, {pick} as beat_ms from (select track_id, i as probe_id, i * 5001 - 500 as at_ms from (select distinct track_id from beats), range(9) r(i)) p
    join (select p.track_id, p.probe_id, coalesce(max(b.at_ms) filter (b.at_ms <= p.at_ms), min(b.at_ms)) as b, coalesce(min(b.at_ms) filter (b.at_ms > p.at_ms), max(b.at_ms)) as a
        from (select track_id, i as probe_id, i * 5001 - 500 as at_ms from (select distinct track_id from beats), range(9) r(i)) p join beats b using (track_id) group by all) n using (track_id, probe_id)"""


@query(PROBES.format(pick="b"), "beats")
def nearest_beat_before(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return timeline.nearest_beat(_probes(b), b, "before")


@query(PROBES.format(pick="a"), "beats")
def nearest_beat_after(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return timeline.nearest_beat(_probes(b), b, "after")


@query(PROBES.format(pick="case when abs(b - p.at_ms) <= abs(a - p.at_ms) then b else a end"), "beats")
def nearest_beat_nearest(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return timeline.nearest_beat(_probes(b), b, "nearest")


@query(
    """select p.track_id, p.x as at, case when abs(n.c - p.x) <= 700 then n.c else p.x end as snapped from (select distinct track_id, cast(end_ms as double) as x from chunks) p join (
    select p.track_id, p.x, arg_min(c, (abs(c - p.x), c)) as c from (select distinct track_id, cast(end_ms as double) as x from chunks) p join (select track_id, cast(at_ms as double) as c from beats where seq % 4 = 0) b using (track_id) group by all) n using (track_id, x)""",
    "chunks",
)
def snap_within_radius(spark, sf_dir):
    b = _beats(spark, sf_dir)
    points = _chunks(b).select(TRACK, F.col("end_ms").cast("double").alias("at")).distinct()
    return timeline.snap_within(points, timeline.downbeats(b).select(TRACK, F.col("at_ms").cast("double").alias("centre")), 700)


@query("select * from placed", "placed")
def chapter_index_at(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return modes.chapter_of(timeline.stanzas(b), _chapters(b))


@query("select track_id, seq, at_ms, at_ms in (select b.at_ms from beats b where b.track_id = o.track_id and b.seq % 4 = 0) as is_downbeat from beats o", "beats")
def is_downbeat(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return timeline.mark_downbeats(b, timeline.downbeats(b))


@query("select track_id, seq, at_ms, energy, pos from beats where energy > 0.85 qualify row_number() over (partition by track_id order by at_ms, seq) <= 5", "beats")
def loud_top5(spark, sf_dir):
    return timeline.loudest(_beats(spark, sf_dir))


@query("select * from stanzas where end_ms > 10000 and start_ms < 20000", "stanzas")
def overlap_slice(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return timeline.slice_beats(b, timeline.stanzas(b), 10_000, 20_000)[1]


@query("select * from bpms", "bpms")
def bpm_upper_median(spark, sf_dir):
    return tempo.bpm(_beats(spark, sf_dir))


@query("select track_id, seq, at_ms, case when max(energy) over (partition by track_id) > 0 then energy / max(energy) over (partition by track_id) else 0 end as energy, pos from beats", "beats")
def energy_max_norm(spark, sf_dir):
    return tempo.max_normalised(_beats(spark, sf_dir))


@query("select b.track_id, b.seq, b.at_ms, b.energy, b.pos, n.norm from beats b join norms n using (track_id, seq)", "norms")
def energy_p95_norm(spark, sf_dir):
    return tempo.p95_normalised(_beats(spark, sf_dir))


@query("select * from f9", "bpms", "fold")
def octave_fold(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return tempo.fold_octaves(b, tempo.bpm(b))


@query(
    """select track_id, cast(row_number() over (partition by track_id order by seq, k) - 1 as int) as seq, at_ms, energy, bpm from (
    select track_id, seq, 0 as k, at_ms, energy, case when lift then bpm * 2 else bpm end as bpm from x
    union all select track_id, seq, 1, (at_ms + nxt) // 2, (energy + ne) / 2, bpm * 2 from x where lift and nxt - at_ms >= 60000e0 / (bpm * 2) * 1.5e0)""",
    "bpms", "lift",
)
def halving_lift(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return tempo.lift_halves(b, tempo.bpm(b).withColumn("ref_bpm", F.col("bpm") * 1.99).withColumn("bpm", F.col("bpm") * 0.75))


@query("select track_id, sum(bpm * dur_ms) / sum(dur_ms) as bpm from (select track_id, chunk_idx % 3 * 64 + 90e0 as bpm, end_ms - at_ms as dur_ms from chunks) group by track_id", "chunks")
def weighted_bpm(spark, sf_dir):
    return tempo.weighted_bpm(_chunks(_beats(spark, sf_dir)).select(TRACK, (F.col("chunk_idx") % 3 * 64 + 90.0).alias("bpm"), (F.col("end_ms") - F.col("at_ms")).alias("dur_ms")))


@query(f"select track_id, {FIVE_B} from beats group by track_id", "beats")
def energy_percentiles(spark, sf_dir):
    return tempo.energy_percentiles(_beats(spark, sf_dir))


@query(f"select track_id, chunk_idx as chapter_idx, {FIVE_B}, 60e0 * count(*) / (max(end_ms - c_at) / 1000) as bpm from (select b.track_id, c.chunk_idx, b.energy, c.end_ms, c.at_ms as c_at from beats b join chunks c on b.track_id = c.track_id and b.at_ms >= c.at_ms and b.at_ms < c.end_ms) group by track_id, chunk_idx", "chunks")
def energy_per_chapter(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return tempo.energy_per_chapter(b, _chapters(b))


@query("select * from trend", "trend")
def energy_trend(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return modes.energy_trend(b, timeline.stanzas(b))


@query("select * from modes", "modes")
def modes_whole(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return modes.modes_whole(b, timeline.stanzas(b))


PER_CHAPTER = """select s.track_id, s.stanza_idx, c.chunk_idx as chapter_idx, s.start_ms, s.end_ms, case when t.n_beats is null or r.med is null or t.avg_energy < greatest(r.med * 0.4e0, 0.1e0) then 'break'
        when t.trend >= 0.15e0 and t.second_avg >= r.med then 'edging' when r.n / greatest(1e-6, (c.end_ms - c.at_ms) / 60000e0) >= 140 then 'fast' when r.n / greatest(1e-6, (c.end_ms - c.at_ms) / 60000e0) <= 75 then 'slow'
        when t.avg_energy < r.med * 0.85e0 then 'tease' else 'steady' end as mode
    from stanzas s join chunks c on s.track_id = c.track_id and s.start_ms >= c.at_ms and s.start_ms < c.end_ms left join trend t on s.track_id = t.track_id and s.stanza_idx = t.stanza_idx
    left join (select b.track_id, c.chunk_idx, median(b.energy) as med, count(*) as n from beats b join chunks c on b.track_id = c.track_id and b.at_ms >= c.at_ms and b.at_ms < c.end_ms group by all) r on c.track_id = r.track_id and c.chunk_idx = r.chunk_idx"""


@query(PER_CHAPTER, "trend", "chunks")
def modes_per_chapter(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return modes.modes_per_chapter(b, timeline.stanzas(b), _chapters(b))


@query(f"select m.track_id, m.stanza_idx, m.start_ms, m.end_ms, m.mode, p.chapter_idx from ({PER_CHAPTER}) m join placed p using (track_id, stanza_idx)", "trend", "placed")
def stanza_records(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return modes.stanza_records(b, timeline.stanzas(b), _chapters(b))


ACTIONS = """select s.track_id, s.stanza_idx, cast(s.chapter_idx as int) as chapter_idx, s.start_ms, s.end_ms, case when coalesce(a.n, 0) < 2 or a.amp < s.brk then 'break' when a.second_amp - a.first_amp >= 15 and a.second_amp >= s.edge then 'edging'
        when a.n * 1000e0 / greatest(1, s.end_ms - s.start_ms) >= 4 then 'fast' when a.n * 1000e0 / greatest(1, s.end_ms - s.start_ms) <= 0.8e0 then 'slow' when a.amp < s.tease then 'tease' else 'steady' end as mode
    from ({spans}) s left join (select track_id, stanza_idx, count(*) as n, max(pos) - min(pos) as amp, coalesce(max(pos) filter (k < n // 2) - min(pos) filter (k < n // 2), 0) as first_amp,
            coalesce(max(pos) filter (k >= n // 2) - min(pos) filter (k >= n // 2), 0) as second_amp from (
        select b.track_id, s.stanza_idx, b.pos, row_number() over (partition by b.track_id, s.stanza_idx order by b.at_ms, b.seq) - 1 as k, count(*) over (partition by b.track_id, s.stanza_idx) as n
        from beats b join astanzas s on b.track_id = s.track_id and b.at_ms >= s.start_ms and b.at_ms < s.end_ms) group by all) a on s.track_id = a.track_id and s.stanza_idx = a.stanza_idx"""
ACTIONS = ACTIONS.replace("select track_id, stanza_idx, count(*) as n, max(pos) - min(pos) as amp", "select track_id, stanza_idx, max(n) as n, max(pos) - min(pos) as amp").replace("group by all) a", "group by track_id, stanza_idx) a").replace("as n\n        from beats b", "as m\n        from beats b").replace("max(n) as n", "max(m) as n").replace("k < n // 2", "k < m // 2").replace("k >= n // 2", "k >= m // 2")


@query(ACTIONS.format(spans="select *, 0 as chapter_idx, 15 as brk, 30 as tease, 35 as edge from astanzas"), "astanzas")
def action_modes(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return modes.action_modes(b, timeline.action_stanzas(b))


@query(
    ACTIONS.format(
        spans="""select p.*, greatest(coalesce(r.amp, 0) * 0.4e0, 10) as brk, coalesce(r.amp, 0) * 0.85e0 as tease, coalesce(r.amp, 0) as edge from (
        select s.track_id, s.stanza_idx, s.start_ms, s.end_ms, coalesce(min(c.chunk_idx), max(l.last)) as chapter_idx from astanzas s
        left join chunks c on s.track_id = c.track_id and (s.start_ms + s.end_ms) // 2 >= c.at_ms and (s.start_ms + s.end_ms) // 2 < c.end_ms join (select track_id, max(chunk_idx) as last from chunks group by track_id) l on s.track_id = l.track_id group by all) p
        left join (select b.track_id, c.chunk_idx as chapter_idx, max(b.pos) - min(b.pos) as amp from beats b join chunks c on b.track_id = c.track_id and b.at_ms >= c.at_ms and b.at_ms < c.end_ms group by all) r using (track_id, chapter_idx)"""
    ),
    "astanzas",
    "chunks",
)
def action_modes_chapter(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return modes.action_modes(b, timeline.action_stanzas(b), _chapters(b))


@query("select track_id, seq, at_ms, energy, arc from arcs", "arcs")
def density_arc_curve(spark, sf_dir):
    return curve.density_arc(_beats(spark, sf_dir)).drop("pos")


@query("select b.track_id, b.seq, b.at_ms, b.energy, b.pos, greatest(0, least(1, coalesce(min(c.chunk_idx) * 0.25e0, 0.55e0))) as arc from beats b left join chunks c on b.track_id = c.track_id and b.at_ms >= c.at_ms and b.at_ms < c.end_ms group by all", "chunks")
def density_arc_levels(spark, sf_dir):
    b = _beats(spark, sf_dir)
    levels = _chunks(b).select(TRACK, F.col("chunk_idx").alias("span_idx"), F.col("at_ms").alias("start_ms"), "end_ms", (F.col("chunk_idx") * 0.25).alias("level"))
    return curve.density_arc_from_levels(b, levels)


@query("select track_id, seq from fire where acc >= 1", "fire")
def fire_accumulator(spark, sf_dir):
    return curve.fired(curve.density_arc(_beats(spark, sf_dir))).select(TRACK, "seq")


@query("select * from tone", "tone")
def auto_tone(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return curve.auto_tone(b, timeline.stanzas(b))


POINTS = """select track_id, seq, cast(k as int) as k, at_ms + k * dur_ms // n as at_ms, cast(greatest(0, least(100, round_even(case when k % 2 = 0 then 50 + half else 50 - half end, 0))) as int) as pos
    from (select *, unnest(range(n)) as k from ({beats}))"""
ARC_N = "greatest(2, cast(case when arc <= 0.45e0 then 2 else 2 + 2 * round_even(least(1e0, (arc - 0.45e0) / 0.55e0) * 2, 0) end as int))"
ARC_POINTS = POINTS.format(beats=f"select f.track_id, f.seq, f.at_ms, f.dur_ms, f.half, {ARC_N} as n from fixed f join arcs a using (track_id, seq) join fire x on f.track_id = x.track_id and f.seq = x.seq where x.acc >= 1")


def _modes(b: DataFrame) -> DataFrame:
    return modes.modes_whole(b, timeline.stanzas(b))


@query(POINTS.format(beats="select *, greatest(2, strokes) as n from fixed where norm >= 0.1e0"), "fixed")
def curve_fixed(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return curve.beats_to_curve(b, modes=_modes(b))


@query(ARC_POINTS, "fixed", "fire")
def curve_fixed_arc(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return curve.beats_to_curve(curve.density_arc(b), modes=_modes(b), arc=True)


@query(
    POINTS.format(
        beats=f"""select f.track_id, f.seq, f.at_ms, f.dur_ms, f.half * (1e0 - 0.4e0 * (1e0 - greatest(0, least(1, (f.norm - q.lo) / case when q.hi = q.lo then 1e0 else q.hi - q.lo end)))) as half, greatest(2, strokes) as n
    from fixed f join (select track_id, list_sort(list(norm))[cast(floor(count(*) * 0.1e0) as int) + 1] as lo, {RANK.format(x="norm", q=0.9)} as hi from norms group by track_id) q using (track_id) where f.norm >= 0.1e0"""
    ),
    "fixed",
)
def curve_texture(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return curve.beats_to_curve(b, modes=_modes(b), texture=0.4)


@query(POINTS.format(beats="select track_id, seq, at_ms, dur_ms, half * (seq % 5 * 0.25e0) as half, greatest(2, 4, strokes) as n from fixed where norm >= 0.1e0"), "fixed")
def curve_gain(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return curve.beats_to_curve(b.withColumn("gain", F.col("seq") % 5 * 0.25), modes=_modes(b), gain=True, stroke_density=4)


CENTRED = """select track_id, seq, cast(k as int) as k, t as at_ms, cast(case when k % 2 = 0 then least(100, round_even(c + half, 0)) else greatest(0, round_even(c - half, 0)) end as int) as pos from (
    select *, round_even(30 + 40 * greatest(0e0, least(1e0, (t - t0) / greatest(t1 - t0, 1))), 0) as c, greatest(10e0, 40e0 * energy) as half
    from (select track_id, seq, k, at_ms + k * dur_ms // 2 as t, energy, min(at_ms) over (partition by track_id) as t0, max(at_ms) over (partition by track_id) as t1 from (select *, unnest(range(2)) as k from nd)))"""


@query(CENTRED, "nd")
def curve_energy_centered(spark, sf_dir):
    return curve.beats_to_curve(_beats(spark, sf_dir), depth_model="energy", center_trajectory=(30, 70), stroke_density="full")


LEGACY = "select track_id, seq, 0 as k, at_ms, cast(case when seq % 2 = 0 then least(100, 10 + greatest(20, round_even(80 * norm, 0))) else 10 end as int) as pos from beats join norms using (track_id, seq)"


@query(LEGACY, "norms")
def curve_energy_legacy(spark, sf_dir):
    return curve.beats_to_curve(_beats(spark, sf_dir), depth_model="energy", energy_normalize=True)


SHAPED = """select track_id, seq, k, at_ms, cast(greatest(0, least(100, round_even(c + (pos - c) * case when mode = 'edging' then 0.5e0 + 0.5e0 * least(1e0, (at_ms - ss) / greatest(1, se - ss))
        when mode = 'break' then 0.12e0 when mode = 'tease' then 0.38e0 when mode = 'slow' then 0.95e0 when mode = 'fast' then 0.7e0 else 0.78e0 end, 0))) as int) as pos from (
    select p.*, coalesce(h.m, l.m)['mode'] as mode, coalesce(h.m, l.m)['start_ms'] as ss, coalesce(h.m, l.m)['end_ms'] as se,
        case when t.track_id is not null then round_even(t.start_center + (t.end_center - t.start_center) * greatest(0e0, least(1e0, (p.at_ms - t.start_ms) / greatest(1, t.end_ms - t.start_ms))), 0) else e.c end as c
    from ({curve}) p left join (select p.track_id, p.seq, p.k, arg_min(m, m.stanza_idx) as m from ({curve}) p join modes m on p.track_id = m.track_id and p.at_ms >= m.start_ms and p.at_ms < m.end_ms group by all) h using (track_id, seq, k)
    join (select track_id, arg_max(m, m.stanza_idx) as m from modes m group by track_id) l on p.track_id = l.track_id
    left join tone t on p.track_id = t.track_id and p.at_ms >= t.start_ms and p.at_ms < t.end_ms
    join (select track_id, arg_max(end_center, stanza_idx) as c from tone group by track_id) e on p.track_id = e.track_id)""".format(curve=CENTRED)


@query(SHAPED, "nd", "modes", "tone")
def shape_curve(spark, sf_dir):
    b = _beats(spark, sf_dir)
    tone = curve.auto_tone(b, timeline.stanzas(b))
    return curve.shape_curve(curve.beats_to_curve(b, depth_model="energy", center_trajectory=(30, 70), stroke_density="full"), _modes(b), tone=tone)


@query(f"select track_id, at_ms, min(pos) as pos from ({LEGACY}) group by track_id, at_ms", "norms")
def export_dedupe(spark, sf_dir):
    return curve.export_points(curve.beats_to_curve(_beats(spark, sf_dir), depth_model="energy", energy_normalize=True))


@query(f"select track_id, at_ms, min(pos) as pos from ({ARC_POINTS}) group by track_id, at_ms", "fixed", "fire")
def generate_default(spark, sf_dir):
    return curve.generate(_beats(spark, sf_dir))


#: The same chain over beats keyed by track and chunk, numbered within it.
PER_CHAPTER_CURVE = f"""with {CTE["beats"].replace("beats as", "beats0 as", 1)}, {CTE["chunks"].replace("from beats group", "from beats0 group")},
    beats as (select {{'t': b.track_id, 'c': c.chunk_idx}} as track_id, b.seq - min(b.seq) over (partition by b.track_id, c.chunk_idx) as seq, b.at_ms, b.energy, b.pos
        from beats0 b join chunks c on b.track_id = c.track_id and b.at_ms >= c.at_ms and b.at_ms < c.end_ms),
    {", ".join(CTE[c] for c in ("stanzas", "trend", "modes", "nd", "norms", "moded", "fixed"))}
    select track_id.t as track_id, track_id.c as chapter_idx, at_ms, min(pos) as pos from (
        select track_id, at_ms + k * dur_ms // n as at_ms, cast(greatest(0, least(100, round_even(case when k % 2 = 0 then c + half else c - half end, 0))) as int) as pos from (
            select *, unnest(range(n)) as k from (select *, case when track_id.c % 2 = 0 then 50 else 45 end as c, greatest(case when track_id.c % 2 = 0 then 2 else 4 end, strokes) as n from fixed where norm >= 0.1e0)))
    group by all"""


@query(PER_CHAPTER_CURVE)
def generate_per_chapter(spark, sf_dir):
    b = _beats(spark, sf_dir)
    bundle = _chapters(b).select(TRACK, "chapter_idx", (F.col("chapter_idx") % 2).alias("recipe"))  # one for every chapter
    return curve.generate_per_chapter(b, _chapters(b), [{}, {"stroke_density": "4", "center": 45}], bundle)


@query(f"select track_id, '{{\"version\":\"1.0\",\"inverted\":false,\"range\":90,\"actions\":[' || string_agg('{{\"at\":' || at_ms || ',\"pos\":' || pos || '}}', ',' order by at_ms) || '],\"metadata\":{{}}}}' as doc from (select track_id, at_ms, min(pos) as pos from ({ARC_POINTS}) group by track_id, at_ms) group by track_id", "fixed", "fire")
def curve_documents(spark, sf_dir):
    return documents.curve_documents(curve.generate(_beats(spark, sf_dir)))


@query("select track_id, max(at_ms) as duration_ms, list(at_ms order by seq) as beats_ms, list(at_ms order by seq) filter (seq % 4 = 0) as downbeats_ms, any_value(bpm) as bpm from beats join bpms using (track_id) group by track_id", "bpms")
def beat_documents(spark, sf_dir):
    b = _beats(spark, sf_dir)
    return documents.beat_documents(b, tempo.bpm(b))


@query("select track_id, case when track_id % 3 = 0 then 'sidecar' when track_id % 3 = 1 then 'mp4' else 'analysis' end as source, case when track_id % 6 = 0 then [] else list(at_ms order by at_ms) end as chapters from chunks group by track_id", "chunks")
def priority_resolver(spark, sf_dir):
    ch = _chunks(_beats(spark, sf_dir)).groupBy(TRACK).agg(F.array_sort(F.collect_list("at_ms")).alias("c"))
    here = F.when(F.col(TRACK) % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.col("c"))
    options = [(0, "sidecar", F.when(F.col(TRACK) % 3 == 0, here)), (1, "mp4", F.when(F.col(TRACK) % 3 <= 1, here)), (2, "analysis", here)]
    each = ch.select(TRACK, F.explode(F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(s).alias("source"), c.alias("chapters")) for p, s, c in options])).alias("o")).select(TRACK, "o.*")
    return resolve_chapters(each)


@query("select track_id, list('{\"type\":\"' || event_type || '\",\"at_ms\":' || at_ms || ',\"params\":' || props || '}' order by at_ms, seq) as events from (select *, replace(props, ' ', '') as p from beats) group by track_id".replace("|| props ||", "|| p ||"), "beats")
def events_roundtrip(spark, sf_dir):
    b = canonical_beats(spark.read.parquet(f"{sf_dir}/events.parquet"))
    doc = F.to_json(F.struct(F.col("event_type").alias("type"), "at_ms", F.from_json("props", "map<string,int>").alias("params")))
    events = documents.parse_events(b.select(TRACK, "seq", doc.alias("doc"))).where("not rejected")
    return documents.write_events(b.select(TRACK).distinct(), events)


STAMP = "case when hours or s // 3600 > 0 then s // 3600 || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') else cast(s // 60 as varchar) end || ':' || lpad(cast(s % 60 as varchar), 2, '0')"


@query(
    f"""select track_id, error, case when error is null then block end as block from (
    select track_id, case when count(*) < 3 then 'fewer than 3 chapters' when min(at_ms) <> 0 then 'first chapter not at 0' when min(gap) < 10000 then 'chapter under 10 s' end as error,
        string_agg({STAMP} || ' ' || coalesce(nullif(name, ''), nullif(intent, ''), 'Chapter ' || i), chr(10) order by i) || chr(10) as block from (
        select *, at_ms // 1000 as s, row_number() over w as i, lead(at_ms) over w - at_ms as gap, max(at_ms) over (partition by track_id) >= 3600000 as hours from chapters window w as (partition by track_id order by at_ms, seq)) group by track_id)""",
    "chapters",
)
def youtube_block(spark, sf_dir):
    return documents.youtube_block(_talks(spark, sf_dir))


@query(
    r"""select track_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || at_ms || chr(10) || 'END=' || e || chr(10) || coalesce('title=' || t || chr(10), ''), '' order by i) as text from (
    select *, greatest(coalesce(end_ms, lead(at_ms) over w, at_ms + 1), at_ms + 1) as e, row_number() over w as i,
        replace(replace(replace(replace(replace(coalesce(nullif(name, ''), nullif(intent, '')), '\', '\\'), '=', '\='), ';', '\;'), '#', '\#'), chr(10), '\' || chr(10)) as t from chapters window w as (partition by track_id order by at_ms, seq)) group by track_id""",
    "chapters",
)
def ffmetadata(spark, sf_dir):
    return documents.ffmetadata(_talks(spark, sf_dir))


def _records(beats: DataFrame, kept: F.Column, **fields: F.Column) -> DataFrame:
    entries = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return beats.where(kept).select(TRACK, F.col("seq").alias("ord"), F.map_filter(F.create_map(F.lit("at_ms"), F.col("at_ms").cast("string"), *entries), lambda _, v: v.isNotNull()).alias("fields"))


def _merged(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    b = _beats(spark, sf_dir).withColumn("at_ms", F.col("seq") * 1000)
    old = _records(b, F.col("seq") % 3 != 2, name=F.concat(F.lit("n"), F.col("seq")), confidence=(F.col("energy") * 1024).cast("int"), tone=F.when(F.col("seq") % 2 == 0, "rise"), auto_generated=F.when(F.col(TRACK) % 3 == 0, "false"))
    new = _records(b, F.col("seq") % 2 == 0, name=F.concat(F.lit("m"), F.col("seq")), confidence=F.col("pos"), tone=F.when(F.col("seq") % 4 == 0, "fall"), end_ms=F.lit("7"), vendor=F.lit("v"))
    out = merge.merge_records(old, new, merge.CHAPTER, mode)
    return out.select(TRACK, "ord", *[F.col("fields")[k].alias(k) for k in ("at_ms", "name", "confidence", "tone", "auto_generated", "end_ms", "vendor")])


MERGE = """select track_id, cast(row_number() over (partition by track_id order by part, seq) - 1 as int) as ord, at_ms, name, confidence, tone, auto_generated, end_ms, vendor from (
    select o.track_id, 0 as part, o.seq, o.at_ms, case when w and {edit} then 'm' || o.seq else 'n' || o.seq end as name, case when w then cast(pos as varchar) else cast(cast(energy * 1024 as int) as varchar) end as confidence,
        case when w and o.seq % 4 = 0 then 'fall' when o.seq % 2 = 0 then 'rise' end as tone, case when o.track_id % 3 = 0 then 'false' when w and {edit} then 'false' end as auto_generated, null as end_ms, case when w then 'v' end as vendor
    from (select *, seq % 2 = 0 and track_id % 3 <> 0 as w from b where seq % 3 <> 2) o
    union all select track_id, 1, seq, at_ms, 'm' || seq, cast(pos as varchar), case when seq % 4 = 0 then 'fall' end, null, '7', 'v' from b where seq % 2 = 0 and seq % 3 = 2)"""


@query(MERGE.format(edit="false"), "b")
def merge_analyze(spark, sf_dir):
    return _merged(spark, sf_dir, "analyze")


@query(MERGE.format(edit="true"), "b")
def merge_edit(spark, sf_dir):
    return _merged(spark, sf_dir, "edit")


@query("select track_id, n, writer, version from (select track_id, unnest(range(2)) as n, 'author' as writer, cast(null as varchar) as version from (select distinct track_id from beats) union all select distinct track_id, 2, 'analyzer', '1' from beats)", "beats")
def provenance_append(spark, sf_dir):
    old = _beats(spark, sf_dir).select(TRACK).distinct().select(TRACK, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("n"), F.lit("author").alias("writer"), F.lit("2026-01-01T00:00:00Z").alias("written_at"), F.lit(None).cast("string").alias("version"), F.array(F.lit("name")).alias("fields"))
    return merge.provenance(old, "analyzer", "analyze", F.array(F.lit("chapters")), F.lit("2026-01-02T00:00:00Z"), "1").select(TRACK, "n", "writer", "version")


SILENCE = """select track_id, min(seq) as first_frame, count(*) as n_frames, (min(seq) + min(seq) + count(*)) / 2 * 0.5e0 as centre from (select *, sum(new) over (partition by track_id order by seq) as island from (
    select *, case when lag(silent) over w is null or lag(silent) over w <> silent then 1 else 0 end as new from (select b.*, energy < ref * 0.3e0 as silent from beats b join (select track_id, quantile_cont(energy, 0.95) as ref from beats group by track_id having ref > 0) using (track_id))
    window w as (partition by track_id order by seq))) where silent group by track_id, island having count(*) >= 2"""


@query(SILENCE, "beats")
def silence_islands(spark, sf_dir):
    return structure.silence_islands(_beats(spark, sf_dir).select(TRACK, F.col("seq").alias("frame_idx"), F.col("energy").alias("rms")), ratio=0.3, min_frames=2, frame_s=0.5)


@query("select track_id, session, min(at_ms) as start_ms, max(at_ms) as end_ms, count(*) as n from (select *, sum(new) over (partition by track_id order by at_ms, seq rows unbounded preceding)::bigint as session from (select *, case when coalesce(at_ms - lag(at_ms) over (partition by track_id order by at_ms, seq) > 600, true) then 1 else 0 end as new from beats)) group by all having end_ms - start_ms >= 200", "beats")
def gap_sessions(spark, sf_dir):
    return structure.sessions(_beats(spark, sf_dir), max_gap=600, min_span=200)


def _cuts(b: DataFrame) -> DataFrame:
    return b.where(F.col("energy") > 0.7).select(TRACK, (F.col("at_ms") / 1000).alias("cut")).unionByName(timeline.durations(b).select(TRACK, F.explode(F.array(F.lit(0.0), F.col("duration_ms") / 1000)).alias("cut"))).distinct()


@query("select * from micro", "micro")
def merge_micro(spark, sf_dir):
    return structure.merge_micro(_cuts(_beats(spark, sf_dir)), 3.0)


ENFORCED = """select track_id, cut from (with g as (select *, cut - b as gap, case when cut - b > 2 then cast(floor((cut - b) / 2) as int) + 1 else 1 end as n from (select *, lag(cut) over (partition by track_id order by cut) as b from cuts))
    select track_id, cut from g union all select track_id, b + k * (gap / n) from (select *, unnest(range(1, n)) as k from g))"""


@query(ENFORCED, "cuts")
def enforce_max(spark, sf_dir):
    return structure.enforce_max(_cuts(_beats(spark, sf_dir)), 2.0)


@query()  # its SQL: more_queries
def chapter_cuts(spark, sf_dir):
    b = _beats(spark, sf_dir)
    tracks = timeline.durations(b).select(TRACK, (F.col("duration_ms") / 1000).alias("duration"))
    bounds = _chunks(b).select(TRACK, (F.col("end_ms") / 1000).alias("at"))
    centres = structure.silence_islands(b.select(TRACK, F.col("seq").alias("frame_idx"), F.col("energy").alias("rms")), ratio=0.3, min_frames=2, frame_s=0.5).select(TRACK, "centre")
    return structure.chapter_cuts(tracks, bounds, centres, target=10.0)


@query("select track_id, case when m >= 0.6e0 and m - a > 0.2e0 then 'music' when a >= 0.6e0 and a - m > 0.2e0 then 'ambient' else '' end as label, case when (m >= 0.6e0 and m - a > 0.2e0) or (a >= 0.6e0 and a - m > 0.2e0) then least(1e0, 0.5e0 + greatest(m, a) / 2) else 0.5e0 + abs(m - a) / 4 end as confidence from (select track_id, case when cv > 0.6 then 0.35e0 else 0 end + case when pr > 0.45 then 0.35e0 else 0 end + case when fl > 0.35 then 0.3e0 else 0 end as m, case when cv < 0.3 then 0.35e0 else 0 end + case when pr < 0.25 then 0.35e0 else 0 end + case when fl < 0.15 then 0.3e0 else 0 end as a from (select track_id, max(energy) filter (seq = 1) as cv, max(energy) filter (seq = 2) as pr, max(energy) filter (seq = 3) as fl from beats group by track_id))", "beats")
def content_label(spark, sf_dir):
    pick = lambda i, name: F.max(F.when(F.col("seq") == i, F.col("energy"))).alias(name)
    return modes.content_label(_beats(spark, sf_dir).groupBy(TRACK).agg(pick(1, "rms_cv"), pick(2, "percussive"), pick(3, "flux")))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beats(spark, sf_dir).select(TRACK, F.col("seq").alias("frame_idx"), F.col("pos").cast("double").alias("score"))


@query("select track_id, seq as frame_idx from (select *, lag(pos) over (partition by track_id order by seq) as p from beats) where abs(pos - p) >= 27", "beats")
def scene_cuts_content(spark, sf_dir):
    return structure.scene_cuts(_scores(spark, sf_dir), "content")


@query("select track_id, seq as frame_idx from (select *, lag(pos) over (partition by track_id order by seq) as p from beats) where (pos >= 12) <> (p >= 12)", "beats")
def scene_cuts_threshold(spark, sf_dir):
    return structure.scene_cuts(_scores(spark, sf_dir), "threshold")


@query("select track_id, seq as frame_idx from (select *, sum(pos) over w - pos as s, count(*) over w - 1 as n from beats window w as (partition by track_id order by seq rows between 2 preceding and 2 following)) where n > 0 and s > 0 and pos / (s / n) >= 3", "beats")
def scene_cuts_adaptive(spark, sf_dir):
    return structure.scene_cuts(_scores(spark, sf_dir), "adaptive")


@query(
    """select track_id, cast(row_number() over w as int) as index, cast(round_even(a * 1000 / 24e0, 0) as bigint) as start_ms, cast(round_even(b * 1000 / 24e0, 0) as bigint) as end_ms, cast(round_even(b * 1000 / 24e0, 0) - round_even(a * 1000 / 24e0, 0) as bigint) as duration_ms
    from (select track_id, f as a, coalesce(lead(f) over (partition by track_id order by f), n) as b from (select distinct track_id, f from (select track_id, 0 as f from beats union all
        select track_id, seq from (select *, lag(pos) over (partition by track_id order by seq) as p from beats) where abs(pos - p) >= 27)) join (select track_id, count(*) as n from beats group by track_id) using (track_id)) window w as (partition by track_id order by a)""",
    "beats",
)
def scene_list(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return structure.scenes(structure.scene_cuts(s, "content"), s.groupBy(TRACK).agg(F.count("*").alias("n_frames")), fps=24.0)


@query("select track_id, frame_idx, list_reduce(list_transform(range(1, len(v) + 1), lambda i: greatest(0e0, cast(v[i] as double) - cast(p[i] as double))), lambda a, b: a + b) / len(v) as flux from (select label as track_id, vec_id as frame_idx, embedding as v, lag(embedding) over (partition by label order by vec_id) as p from embeddings) where p is not null")
def spectral_flux(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return structure.spectral_flux(e.select(F.col("label").alias(TRACK), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("vec")))


@query("select track_id, seq as idx, max(abs(energy)) over (partition by track_id order by seq rows between 4 preceding and 3 following) as env from beats", "beats")
def sliding_envelope(spark, sf_dir):
    return structure.sliding_max(_beats(spark, sf_dir).select(TRACK, F.col("seq").alias("idx"), F.col("energy").alias("x")), 8)


@query("select track_id, seq as idx, (sum(energy) over w + greatest(0, 4 - seq) * first_value(energy) over t + greatest(0, seq + 3 - (count(*) over (partition by track_id) - 1)) * last_value(energy) over t) / 8 as mean from beats window w as (partition by track_id order by seq rows between 4 preceding and 3 following), t as (partition by track_id order by seq rows between unbounded preceding and unbounded following)", "beats")
def sliding_gain(spark, sf_dir):
    return structure.sliding_mean(_beats(spark, sf_dir).select(TRACK, F.col("seq").alias("idx"), F.col("energy").alias("x")), 8)


@query("select track_id, seq, at_ms, energy, pos from beats join norms using (track_id, seq) where norm >= 0.1e0", "norms")
def energy_gate(spark, sf_dir):
    return tempo.p95_normalised(_beats(spark, sf_dir)).where("norm >= 0.1").drop("norm")


@query("select track_id, round_even(bpm * 1000, 0) / 1000 as bpm, case when bpm > 0 then 60000 / bpm end as interval_ms from bpms", "bpms")
def beat_interval(spark, sf_dir):
    t = tempo.bpm(_beats(spark, sf_dir))
    return t.select(TRACK, (F.rint(F.col("bpm") * 1000) / 1000).alias("bpm"), F.try_divide(F.lit(60000.0), F.nullif("bpm", F.lit(0.0))).alias("interval_ms"))


@query("select track_id, hop_idx, case when max(rms) over (partition by track_id) > 0 then rms / max(rms) over (partition by track_id) else rms end as peak from (select track_id, h as hop_idx, sqrt(avg(energy * energy)) as rms from (select b.track_id, b.energy, h.h, h.lo, h.hi, b.seq from beats b join (select track_id, unnest(range(cast(floor(count(*) / 3.3e0) as bigint))) as h, null as lo, null as hi from beats group by track_id) h on b.track_id = h.track_id and b.seq >= round_even(h.h * 3.3e0, 0) and b.seq < round_even((h.h + 1) * 3.3e0, 0)) group by track_id, h)", "beats")
def peaks_exact_hop(spark, sf_dir):
    return structure.exact_hop_peaks(_beats(spark, sf_dir).select(TRACK, F.col("seq").alias("idx"), F.col("energy").alias("x")), sr=1000, hop_ms=3.3)


def _shell(name: str, sql: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLE_SQL[name] = f, sql


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recordings with names of every sort: (media_id, path, width)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    suffix = F.when(F.col("p_size") % 3 == 0, ".MKV").when(F.col("p_size") % 3 == 1, ".mp4").otherwise("")
    path = F.concat(F.lit("/media/"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string"), suffix)
    return part.select(F.col("p_partkey").alias("media_id"), path.alias("path"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 80).cast("int").alias("width"))


def _clip_chapters(media: DataFrame) -> DataFrame:
    """Four chapters each: one without an end, one that ends where it begins, two good ones."""
    c = media.select("media_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chapter_idx"))
    at = F.col("chapter_idx").cast("long") * 60_000
    end = F.when(F.col("chapter_idx") == 3, F.lit(None)).when(F.col("chapter_idx") == 2, at).otherwise(at + 1000 + F.col("media_id") % 100)
    return c.select("media_id", "chapter_idx", at.alias("at_ms"), end.cast("long").alias("end_ms"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = _recordings(spark, sf_dir)
    chapters = _clip_chapters(media)
    there = chapters.where("chapter_idx = 1").join(media, "media_id").where("media_id % 10 = 0").select(shell.clip_path(F.col("path"), F.col("at_ms"), F.col("end_ms")).alias("path"))
    return shell.clip_plan(media, chapters, there)


RECORDINGS = """media as (select p_partkey as media_id, '/media/' || p_size || '/' as folder, p_name || ' #' || p_partkey as stem,
        case p_size % 3 when 0 then 'mkv' else 'mp4' end as kind, case when p_size % 7 <> 0 then p_size * 80 end as width from part),
    clips as (select media_id, cast(i as int) as chapter_idx, folder || '.' || stem || '.forge/clips/' || coalesce(nullif(trim(regexp_replace(stem, '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), ''), 'media') || '_v13_' || i * 60000 || '_'
            || case i when 2 then 120000 else i * 60000 + 1000 + media_id % 100 end || '.' || kind as clip, case when width > 1920 then '720p' else 'source' end as encode,
        case when i = 2 then 'rejected' when i = 1 and media_id % 10 = 0 then 'cached' else 'build' end as status from media, range(3) r(i))"""
_shell("clip_plan", f"with {RECORDINGS} select * from clips", _clips)
_shell("clip_batch", f"with {RECORDINGS} select media_id, total, cached, built, (built + cached) || '/' || total || ' clips ready (' || cached || ' cached, ' || built || ' built)' as summary from (select media_id, count(*) as total, count(*) filter (status = 'cached') as cached, count(*) filter (status = 'build' and not (chapter_idx = 0 and media_id % 4 = 0)) as built from clips where status <> 'rejected' group by media_id)", lambda spark, d: shell.clip_batch(_clips(spark, d), _clips(spark, d).where("chapter_idx = 0 and media_id % 4 = 0 and status = 'build'").select("clip")))
_shell("sidecar_paths", f"with {RECORDINGS} select media_id, folder || '.' || stem || '.forge/' || stem || '.chapters.json' as chapters, folder || '.' || stem || '.forge/' || stem || '.beats.json' as beats from media", lambda spark, d: _recordings(spark, d).select("media_id", shell.sidecar_path(F.col("path"), "chapters").alias("chapters"), shell.sidecar_path(F.col("path"), "beats").alias("beats")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, some of them unreadable: (media_id, path, mtime_ns, size)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("media_id"), F.concat(F.lit("/media/"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("path"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("mtime_ns"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("size"))


def _cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    slot = shell.cache_slot(shell.cache_key(F.col("path"), F.col("mtime_ns"), F.col("size")), "/tmp/audio")
    meta = F.when(F.col("media_id") % 4 == 0, F.format_string('{"damaged_after_ms": %d, "sr": 22050}', F.col("media_id") * 10)).when(F.col("media_id") % 4 == 1, '{"damaged_after_ms": null}').when(F.col("media_id") % 4 == 2, '{"damaged')
    slots = files.where("media_id % 3 = 0").select(slot.alias("path"), (F.col("media_id") % 7).alias("length"), meta.alias("meta")).where("path is not null")
    return shell.cache_lookup(files, slots, folder="/tmp/audio")


CACHE_KEY = "select o_orderkey as media_id, case when o_orderkey % 50 = 0 then '' else substr(sha256(concat_ws('|', '/media/' || o_orderkey || '.mp4', cast(epoch_us(o_orderdate) * 1000 as varchar), cast(o_custkey as varchar), '22050', '1')), 1, 16) end as cache_key from orders"
_shell("cache_key", CACHE_KEY, lambda spark, d: _files(spark, d).select("media_id", shell.cache_key(F.col("path"), F.col("mtime_ns"), F.col("size")).alias("cache_key")))
_shell("cache_lookup", f"select media_id, slot, hit, case when hit then slot end as load_path, case when hit and media_id % 4 = 0 then media_id * 10 end as damaged_after_ms from (select media_id, case when cache_key <> '' then '/tmp/audio/fa-' || cache_key || '.wav' end as slot, cache_key <> '' and media_id % 3 = 0 and media_id % 7 > 0 as hit from ({CACHE_KEY}))", _cache_lookup)
_shell("eta_ema", f"with recursive {CTE['beats']}, e as (select track_id, seq, cast(at_ms as double) as ema from beats where seq = 0 union all select b.track_id, b.seq, 0.3e0 * b.at_ms + (1e0 - 0.3e0) * e.ema from e join beats b on b.track_id = e.track_id and b.seq = e.seq + 1) select track_id, arg_max(ema, seq) as ema from e group by track_id", lambda spark, d: shell.ema(load_beats(spark, d)))
#: Columns of line items as what a probe says of a video stream; written once here, and once for each engine below.
STREAM = {
    "codec_name": "case l_linenumber when 6 then 'hevc' when 7 then null else 'H264' end", "pix_fmt": "case l_returnflag when 'A' then 'yuv420p' when 'R' then 'yuv420p10le' end",
    "profile": "case l_partkey % 5 when 0 then 'High 10' when 1 then 'High422' else 'High' end", "width": "case when l_suppkey % 11 <> 0 then cast(floor(l_quantity * 80) as int) end",
    "color_transfer": "case l_suppkey % 13 when 0 then 'smpte2084' when 1 then 'ARIB-STD-B67' else 'bt709' end", "color_primaries": "case when l_suppkey % 17 = 0 then 'bt2020' end",
    "avg_frame_rate": "case when l_tax = 0 then '0/0' else concat('30000/', cast(1000 + cast(floor(l_discount * 300) as int) as string)) end", "r_frame_rate": "case when l_suppkey % 19 = 0 then 'unknown' else '30/1' end",
}


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as recordings and their video streams; some have none."""
    video = F.struct(*[F.expr(v).alias(k) for k, v in STREAM.items()])
    there = (F.col("l_partkey") % 97 != 0) & ~((F.col("l_linenumber") == 5) & (F.col("l_orderkey") % 2 == 1))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.struct("l_orderkey", "l_linenumber").alias("media_id"), F.when(there, video).alias("video"))


_shell(
    "cfr_direct_play",
    f"""select l_orderkey, l_linenumber, coalesce(cfr, false) as cfr, coalesce(cfr, false) and coalesce(lower(codec_name), '') = 'h264' and coalesce(pix_fmt, '') in ('', 'yuv420p') and profile not like '%10%' and profile not like '%422%' and profile not like '%444%'
        and coalesce(width, 0) <= 2560 and lower(color_transfer) not in ('smpte2084', 'arib-std-b67') and coalesce(color_primaries, '') <> 'bt2020' as direct
    from (select *, there and avg_frame_rate <> '0/0' and r_frame_rate = '30/1' and abs(30000e0 / try_cast(split_part(avg_frame_rate, '/', 2) as double) - 30e0) <= 0.01e0 * 30e0 as cfr from (
        select *, l_partkey % 97 <> 0 and not (l_linenumber = 5 and l_orderkey % 2 = 1) as there from (select *, {", ".join(f"{v} as {k}" for k, v in STREAM.items())} from lineitem)))""",
    lambda spark, d: shell.direct_play(_probed(spark, d)).select("media_id.*", "cfr", "direct"),
)


def _signals(spark: SparkSession, sf_dir: str, sr: int = 2205):
    """A click per beat of each track, as loud as its energy: one chunk of samples a track (there are no recordings)."""
    import numpy as np

    from chronoloom.dsp.plans import Made

    b = load_beats(spark, sf_dir).groupBy(TRACK).agg(F.array_sort(F.collect_list(F.struct("at_ms", "energy"))).alias("b"))

    def make(batch):
        for track, beats in zip(batch.column(TRACK).to_pylist(), batch.column("b")):
            at, energy = (beats.values.field(name).to_numpy(zero_copy_only=False) for name in ("at_ms", "energy"))
            y = np.zeros(int((int(at[-1]) + 500) * sr / 1000), np.float32)
            click = np.arange(11.0) * (-energy / 10)[:, None] + energy[:, None]
            click[:, -1] = 0
            np.add.at(y, (at * sr / 1000).astype(np.int64)[:, None] + np.arange(11), click.astype(np.float32))
            yield track, 0, sr, 0, y, len(y) / sr

    return Made(b, make)


@query()
def dsp_beats(spark, sf_dir):
    from chronoloom.dsp import plans as dsp

    return dsp.beats(_signals(spark, sf_dir))


@query()
def dsp_textures(spark, sf_dir):
    from chronoloom.dsp import plans as dsp

    return dsp.textures(_signals(spark, sf_dir))


@query()
def dsp_spectrograms(spark, sf_dir):
    from chronoloom.dsp import plans as dsp

    return dsp.spectrograms(_signals(spark, sf_dir), n_mels=16, fmax=1000.0)


QUERIES["patterns_catalog"] = lambda spark, d: shell.patterns(spark)
_shell("detectors", "select * from (values " + ", ".join(f"('{k}', {a}::double, {b}::double, {c}::double)" for k, (a, b, c) in shell.DETECTORS.items()) + ") t(detector, threshold_default, threshold_min, threshold_max)", lambda spark, d: shell.detectors(spark))

from chronoloom.plans import more_queries  # noqa: E402,F401 - adds to QUERIES and ORACLE_SQL
