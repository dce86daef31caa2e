"""SQL that fits the models by Newton's method, independently of the operators: steps are written out as common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from touchline.catalog import sql as S

STEPS = 10


def geometry_fits(steps: int = STEPS) -> str:
    """Two scaled features ``z1``, ``z2`` and the label ``y`` of ``nr``, a model for each ``g``; the systems are solved by cofactors. Ends in
    ``m{steps}(g, b0, b1, b2)``."""
    out = ["m0 as materialized (select distinct g, 0e0 as b0, 0e0 as b1, 0e0 as b2 from nr)"]
    for i in range(steps):
        out.append(f"""
s{i} as materialized (
  select g, any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2, sum(w) as a, sum(w*z1) as b, sum(w*z2) as c, sum(w*z1*z1) + 1 as d,
    sum(w*z1*z2) as e, sum(w*z2*z2) + 1 as f, sum(p - y) as g0, sum((p - y)*z1) + any_value(b1) as g1, sum((p - y)*z2) + any_value(b2) as g2
  from (select *, p*(1 - p) as w from (select nr.*, b0, b1, b2, 1/(1 + exp(-(b0 + b1*z1 + b2*z2))) as p from nr join m{i} using (g)) q) q group by g),
m{i + 1} as materialized (
  select g, b0 - ((d*f - e*e)*g0 + (c*e - b*f)*g1 + (b*e - c*d)*g2)/det as b0, b1 - ((c*e - b*f)*g0 + (a*f - c*c)*g1 + (b*c - a*e)*g2)/det as b1,
    b2 - ((b*e - c*d)*g0 + (b*c - a*e)*g1 + (a*d - b*b)*g2)/det as b2
  from (select *, a*(d*f - e*e) - b*(b*f - c*e) + c*(b*e - c*d) as det from s{i}) q)""")
    return ",".join(out)


def fits(features: int, c: float, steps: int = STEPS) -> str:
    """Features ``x1`` to ``xm`` and the label ``y`` of ``nr``; the systems are solved by elimination on nested lists. Ends in ``b{steps}(b)``."""
    m, ridge = features, repr(1.0 / c)
    xs = ["1", *[f"x{j}" for j in range(1, m + 1)]]
    margin = " + ".join(["b[1]", *[f"b[{j + 1}]*x{j}" for j in range(1, m + 1)]])
    sums = ", ".join(f"sum(w*{xs[i]}*{xs[j]}) as h{i}_{j}" for i in range(m + 1) for j in range(i, m + 1))
    slopes = ", ".join(f"sum((p - y)*{x}) as g{i}" for i, x in enumerate(xs))
    rows = ", ".join(
        "[" + ", ".join(f"h{min(i, j)}_{max(i, j)}" + (f" + {ridge}" if i == j and i else "") for j in range(m + 1)) + f", g{i}" + (f" + {ridge}*b[{i + 1}]" if i else "") + "]"
        for i in range(m + 1)
    )
    out = [f"b0 as materialized (select [{', '.join(['0e0'] * (m + 1))}] as b)"]
    for i in range(steps):
        out.append(f"""
h{i} as materialized (select any_value(b) as b, {sums}, {slopes} from (
  select *, p*(1 - p) as w from (select *, 1/(1 + exp(-({margin}))) as p from nr cross join b{i}) q) q),
e{i} as (
  select 0 as k, [{rows}] as a from h{i}
  union all
  select k + 1, [case when r = k + 1 then prow else [a[r][j] - a[r][k + 1]*prow[j] for j in range(1, {m + 3})] end for r in range(1, {m + 2})]
  from (select k, a, [v/a[k + 1][k + 1] for v in a[k + 1]] as prow from e{i} where k <= {m}) q),
b{i + 1} as materialized (select [b[j] - a[j][{m + 2}] for j in range(1, {m + 2})] as b from b{i} cross join e{i} where k = {m + 1})""")
    return ",".join(out)


def bucket_fits(name: str, rows: str, c: float = 1.0, steps: int = STEPS + 2) -> str:
    """A bucket effect beside intercept and ``xg``: ``rows(bucket, xg, y)``; buckets are eliminated first. Ends in ``{name}_scored``, the rows with
    ``p`` and ``v``, the effect of their bucket."""
    n, lam = name, repr(1.0 / c)
    out = [f"{n}_r as materialized ({rows})", f"{n}_v0 as materialized (select distinct bucket, 0e0 as v, 0e0 as b0, 0e0 as b1 from {n}_r)"]
    score = f"select r.*, v, b0, b1, 1/(1 + exp(-(b0 + b1*xg + v))) as p from {n}_r r join {n}_v{{i}} using (bucket)"
    for i in range(steps):
        out.append(f"""
{n}_s{i} as materialized (
  select bucket, any_value(v) as v, any_value(b0) as b0, any_value(b1) as b1, sum(w) as w, sum(w*xg) as wx, sum(w*xg*xg) as wxx, sum(p - y) as g, sum((p - y)*xg) as gx
  from (select *, p*(1 - p) as w from ({score.format(i=i)}) q) q group by bucket),
{n}_t{i} as materialized (
  select sum(w - w*w/(w + {lam})) as a, sum(wx - w*wx/(w + {lam})) as b, sum(wxx - wx*wx/(w + {lam})) + {lam} as d,
    sum(g - w*(g + {lam}*v)/(w + {lam})) as s0, sum(gx - wx*(g + {lam}*v)/(w + {lam})) + {lam}*any_value(b1) as s1 from {n}_s{i}),
{n}_v{i + 1} as materialized (
  select bucket, v - (g + {lam}*v + w*d0 + wx*d1)/(w + {lam}) as v, b0 + d0 as b0, b1 + d1 as b1
  from {n}_s{i} cross join (select -(d*s0 - b*s1)/(a*d - b*b) as d0, -(a*s1 - b*s0)/(a*d - b*b) as d1 from {n}_t{i}) q)""")
    out.append(f"{n}_scored as materialized ({score.format(i=steps)})")
    return ", ".join(out)


def bucket_rows(name: str, columns: Sequence[str], least: int) -> str:
    """The bucket table of ``{name}_scored``, whose rows also hold the bucket's columns."""
    cols = ", ".join(columns)
    return f"""select *, goals/shots as goal_rate, xg_total/shots as xg_per_shot, goals/shots - xg_total/shots as lift_vs_xg,
    goals/shots - modeled_prob as lift_vs_model, exp(bucket_logit) as odds_multiplier
  from (select {cols}, count(*) as shots, sum(y)::bigint as goals, sum(xg) as xg_total, avg(p) as modeled_prob, any_value(v) as bucket_logit
    from {name}_scored group by {cols} having count(*) >= {least}) q"""


BUCKET_DOUBLES = ["xg_total", "modeled_prob", "goal_rate", "xg_per_shot", "lift_vs_xg", "lift_vs_model", "bucket_logit", "odds_multiplier"]


def balanced_folds(sizes: range = range(32, 0, -1), k: int = 5) -> str:
    """``folds(match_id, fold)`` of the shots ``l``: largest matches first, each to the lightest fold. Among m matches of one size s, the fold f
    with load v is chosen once for each of its keys (v + j s, f) under the m smallest; no match of the test views has over 32 shots."""
    out = ["sized as materialized (select match_id, count(*) as n, row_number() over (partition by count(*) order by match_id) as i from l group by match_id)",
           f"load{sizes[0] + 1} as materialized (select unnest(range({k})) as f, 0 as v)"]
    for s in sizes:
        out.append(f"""
given{s} as materialized (
  select f, count(*) as m from (select f, row_number() over (order by key, f) as place from (
    select f, v + j*{s} as key from load{s + 1} cross join (select unnest(range((select count(*) from sized where n = {s}))) as j) q) q) q
  where place <= (select count(*) from sized where n = {s}) group by f),
load{s} as materialized (select f, v + {s}*coalesce(m, 0) as v from load{s + 1} left join given{s} using (f))""")
    every = " union all ".join(f"select {s} as n, f, sum(m) over (order by f) as upto, m from given{s}" for s in sizes)
    out.append(f"""
parts as materialized ({every}),
folds as materialized (select match_id, f as fold from sized join parts on parts.n = sized.n and i <= upto and i > upto - m)""")
    return ",".join(out)


def training() -> tuple[list[str], list[str], str]:
    """(names of the contextual model's inputs, their expressions over ``st``, tables that end in ``nr``)."""
    numeric = {"shot_distance": "shot_distance", "shot_angle": "shot_angle", "statsbomb_xg": "xg", "score_diff_at_shot": "l_linenumber - 4",
               "minute": "minute", "time_gap_seconds": "coalesce(case when second%7 <> 0 then second end, mid)"}
    diff = "(l_linenumber - 4)"
    binary = {"is_leading": f"{diff} > 0", "is_trailing": f"{diff} < 0", "is_drawing": f"{diff} = 0", "possession_match": "second%2 = 0"}
    levels = {
        "score_state": (S.score_state(diff), ["Leading 1", "Leading 2+", "Level", "Trailing 1", "Trailing 2+"]),
        "simple_state": (S.simple_state(diff), ["Drawing", "Leading", "Trailing"]),
        "pressure_state": ("case when under_pressure then 'Under pressure' else 'Not under pressure' end", ["Not under pressure", "Under pressure"]),
        "set_piece_category": ("set_piece_category", ["Corner", "Direct Free Kick", "Open Play", "Penalty", "Throw In"]),
    }
    names = [*numeric, *binary, *[f"{n}_{v}" for n, (_, values) in levels.items() for v in values]]
    filled = ", ".join(f"({e})::double as n_{n}" for n, e in numeric.items())
    scaled = [f"(n_{n} - avg(n_{n}) over ())/stddev_pop(n_{n}) over ()" for n in numeric]
    flags = [f"({e})::int::double" for e in binary.values()]
    flags += [f"(({e}) = '{v}')::int::double" for e, values in levels.values() for v in values]
    columns = ", ".join(f"{e} as x{i + 1}" for i, e in enumerate([*scaled, *flags]))
    tables = f""",
filled as materialized (select *, {filled} from lg cross join (select median(case when second%7 <> 0 then second end) as mid from lg) q),
nr as materialized (select shot_id, match_id, is_goal, is_goal::int as y, {columns} from filled)"""
    return names, [*scaled, *flags], tables


def clusters(rows: str, features: Sequence[str], key: Sequence[str], k: int = 6, steps: int = 40) -> str:
    """k-means of the ``train`` rows of ``rows``: the farthest row after another, then Lloyd steps. Ends in ``lloyd(key, j, d, train)``, the nearest
    centre of each row."""
    n = len(features)
    zs = [f"z{i}" for i in range(n)]
    z, keys = ", ".join(zs), ", ".join(key)
    scaled = ", ".join(f"coalesce(({f} - avg({f}) over ())/coalesce(nullif(stddev_pop({f}) over (), 0), 1), 0) as {name}" for f, name in zip(features, zs, strict=True))
    far = ", ".join(f"{x} desc" for x in zs)
    gap = " + ".join(f"(r.{x} - c.{x})*(r.{x} - c.{x})" for x in zs)
    out = [f"kz as materialized (select {keys}, train, {scaled} from ({rows}) q)", "kt as materialized (select * from kz where train)",
           f"far1 as materialized (select 0 as j, {z} from kt order by {' + '.join(f'{x}*{x}' for x in zs)} desc, {far} limit 1)"]
    for i in range(1, k):
        out.append(f"""far{i + 1} as materialized (select * from far{i} union all select * from (
  select {i} as j, {z} from (select {', '.join('r.' + x for x in zs)}, min({gap}) as d from kt r cross join far{i} c group by all) q where d > 0 order by d desc, {far} limit 1) q)""")
    out.append(f"ctr0 as materialized (select *, false as still from far{k})")
    shift = " + ".join(f"({x} - o{i})*({x} - o{i})" for i, x in enumerate(zs))
    for i in range(steps):
        out.append(f"""ctr{i + 1} as materialized (select j, {z}, was or sum({shift}) over () <= 1e-4 as still from (
  select c.j, c.still as was, {', '.join(f'case when c.still then c.{x} else coalesce(m.{x}, c.{x}) end as {x}, c.{x} as o{y}' for y, x in enumerate(zs))}
  from ctr{i} c left join (
    select near.j as j, {', '.join(f'avg({x}) as {x}' for x in zs)} from (
      select {keys}, {', '.join(f'any_value(r.{x}) as {x}' for x in zs)}, min(struct_pack(d := {gap}, j := c.j)) as near from kt r cross join ctr{i} c group by {keys}) q
    group by near.j) m using (j)) q)""")
    out.append(f"""lloyd as materialized (select {keys}, near.j as j, near.d as d, train from (
  select {keys}, any_value(train) as train, min(struct_pack(d := {gap}, j := c.j)) as near from kz r cross join ctr{steps} c group by {keys}) q)""")
    return ", ".join(out)
