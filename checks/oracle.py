"""DuckDB SQL that states what each operator must return.

The SQL is written per attribute and level, the long way, so that it shares no
plan with the Spark code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from checks.fixtures import Fixture

NULL_TEXT = "cast(null as varchar)"


def with_ctes(ctes: Sequence[tuple[str, str]], body: str) -> str:
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in ctes) + "\n" + body


def base(fix: Fixture) -> list[tuple[str, str]]:
    return [("f", fix.base)]


# --- counts ------------------------------------------------------------------


def xy(fix: Fixture) -> str:
    return " union all ".join(
        f"select {num} as attr_num, '{a}' as attr_name, {a} as attr_value, y as class, count(*) as n from f group by {a}, y"
        for a, num in fix.attrs.items()
    )


def pairs(fix: Fixture) -> str:
    by_num = sorted(fix.attrs.items(), key=lambda t: t[1])
    parts = []
    for i, (a, an) in enumerate(by_num):
        for b, bn in by_num[:i]:
            parts.append(
                f"select {an} as attr_num1, {a} as attr_value1, {bn} as attr_num2, {b} as attr_value2, y as class, "
                f"count(*) as n from f group by {a}, {b}, y"
            )
    return " union all ".join(parts)


def count_ctes(fix: Fixture) -> list[tuple[str, str]]:
    return [
        *base(fix),
        ("yc", "select y as class, count(*) as n from f group by y"),
        ("tot", "select cast(count(*) as double) as n from f"),
        ("xy", xy(fix)),
        ("pairs", pairs(fix)),
        (
            "sizes",
            "select attr_num, attr_name, count(distinct coalesce(attr_value, '~')) as num_values from xy group by attr_num, attr_name",
        ),
    ]


# --- measures and structure --------------------------------------------------

MI = """
  select attr_num, attr_name,
         sum(cast(n as double) / total * log2(cast(n as double) * total / (cast(n_value as double) * n_class))) as mi
  from (select x.*, v.n_value, yc.n as n_class, tot.n as total
        from xy x
        join (select attr_num, attr_value, sum(n) as n_value from xy group by attr_num, attr_value) v
          on x.attr_num = v.attr_num and x.attr_value = v.attr_value
        join yc on x.class = yc.class
        cross join tot) c
  group by attr_num, attr_name"""

CMI = """
  select attr_num1, attr_num2,
         sum(cast(n as double) / total * log2(cast(n as double) * n_class / (cast(n1 as double) * n2))) as cmi
  from (select p.*, a.n as n1, b.n as n2, yc.n as n_class, tot.n as total
        from pairs p
        join xy a on a.attr_num = p.attr_num1 and a.attr_value = p.attr_value1 and a.class = p.class
        join xy b on b.attr_num = p.attr_num2 and b.attr_value = p.attr_value2 and b.class = p.class
        join yc on yc.class = p.class
        cross join tot) c
  group by attr_num1, attr_num2"""

RANKED = "select *, cast(row_number() over (order by round(mi, 12) desc, attr_num) as integer) as mi_rank from mi"


def measure_ctes(fix: Fixture) -> list[tuple[str, str]]:
    return [*count_ctes(fix), ("mi", MI), ("cmi", CMI), ("ranked", RANKED)]


def parents(k: int) -> str:
    return f"""
  select * from (
    select c.attr_num, c.attr_name, c.mi_rank, p.attr_num as parent_num, p.attr_name as parent, p.mi_rank as parent_rank,
           coalesce(m.cmi, 0.0) as cmi,
           cast(row_number() over (partition by c.attr_num order by round(coalesce(m.cmi, 0.0), 12) desc, p.mi_rank) as integer) as cmi_rank
    from ranked c join ranked p on c.mi_rank > p.mi_rank
    left join cmi m on m.attr_num1 = greatest(c.attr_num, p.attr_num) and m.attr_num2 = least(c.attr_num, p.attr_num)
  ) where cmi_rank <= {k}"""


def structure_ctes(fix: Fixture, k: int) -> list[tuple[str, str]]:
    return [
        *measure_ctes(fix),
        ("parents", parents(k)),
        (
            "structure",
            f"""
  select r.attr_num, r.attr_name, p.parent, r.mi_rank, p.cmi_rank, s.num_values
  from ranked r join sizes s on s.attr_num = r.attr_num left join parents p on p.attr_num = r.attr_num
  union all
  select {fix.label_num}, '{fix.label}', 'KDB$CLASS', null, null, (select count(*) from yc where class is not null)""",
        ),
    ]


# --- parameters --------------------------------------------------------------


def _parent_select(names: Sequence[str], k: int) -> str:
    values = list(names) + [NULL_TEXT] * (k - len(names))
    return ", ".join(f"{v} as parent{i}" for i, v in enumerate(values, start=1))


def width(parents_of: Mapping[str, Sequence[str]]) -> int:
    return max(len(p) for p in parents_of.values())


def conditional(fix: Fixture, parents_of: Mapping[str, Sequence[str]], source: str = "f") -> str:
    k = width(parents_of)
    parts = []
    for a, ps in parents_of.items():
        for level in range(len(ps) + 1):
            used = list(ps[:level])
            parts.append(
                f"select {fix.attrs[a]} as attr_num, '{a}' as attr_name, {level} as level, {a} as attr_value, "
                f"{_parent_select(used, k)}, y as class, count(*) as n from {source} group by {', '.join([a, *used, 'y'])}"
            )
    return " union all ".join(parts)


def _same(a: str, b: str, k: int) -> str:
    return " and ".join(f"{a}.parent{i} is not distinct from {b}.parent{i}" for i in range(1, k + 1))


def model_ctes(fix: Fixture, parents_of: Mapping[str, Sequence[str]], fill: str = "sparse") -> list[tuple[str, str]]:
    k = width(parents_of)
    ps = ", ".join(f"parent{i}" for i in range(1, k + 1))
    if fill == "sparse":
        cells = f"select distinct attr_num, attr_name, level, attr_value, {ps} from cond"
    else:
        cells = f"""
  select p.attr_num, p.attr_name, p.level, d.attr_value, {', '.join(f'p.parent{i}' for i in range(1, k + 1))}
  from (select distinct attr_num, attr_name, level, {ps} from cond) p
  join (select distinct attr_num, attr_value from cond where level = 0) d on d.attr_num = p.attr_num"""
    return [
        *base(fix),
        ("yc", "select y as class, count(*) as n from f group by y"),
        ("cond", conditional(fix, parents_of)),
        ("cells", cells),
        (
            "paths",
            f"select attr_num, level, {ps}, class, cast(sum(n) as bigint) as parents_count from cond group by attr_num, level, {ps}, class",
        ),
        ("nv", "select attr_num, count(distinct attr_value) as num_values from cond where level = 0 group by attr_num"),
        (
            "model",
            f"""
  select c.attr_num, c.attr_name, c.attr_value, {', '.join(f'c.parent{i}' for i in range(1, k + 1))}, yc.class,
         coalesce(o.n, 0) as n, c.level, nv.num_values, coalesce(p.parents_count, 0) as parents_count
  from cells c cross join yc
  join nv on nv.attr_num = c.attr_num
  left join cond o on o.attr_num = c.attr_num and o.level = c.level and o.attr_value = c.attr_value
       and {_same('o', 'c', k)} and o.class = yc.class
  left join paths p on p.attr_num = c.attr_num and p.level = c.level and {_same('p', 'c', k)} and p.class = yc.class""",
        ),
    ]


def prior_rows(k: int) -> str:
    nulls = ", ".join(f"{NULL_TEXT} as parent{i}" for i in range(1, k + 1))
    return f"""
  select cast(null as integer) as attr_num, {NULL_TEXT} as attr_name, {NULL_TEXT} as attr_value, {nulls}, class, n,
         0 as level, (select count(*) from yc) as num_values, (select cast(sum(n) as bigint) from yc) as parents_count
  from yc"""


LOG_PROB = "ln(greatest((n + 1e0 / num_values) / (parents_count + 1e0), 1e-75))"


# --- scoring -----------------------------------------------------------------


def match_ctes(
    fix: Fixture, parents_of: Mapping[str, Sequence[str]], rows_sql: str, backoff: str = "pair", missing: Sequence[str] = ()
) -> list[tuple[str, str]]:
    """Model, scoring rows ``s`` and ``matches`` at the level each backoff picks from."""
    # The dense model has a cell for every seen path and known value, so its
    # deepest match is the path rule.
    ctes = model_ctes(fix, parents_of, "sparse" if backoff == "pair" else "dense")
    parts = []
    for a, ps in parents_of.items():
        if a in missing:
            continue
        bound = next((i for i, p in enumerate(ps) if p in missing), len(ps))
        for level in range(bound + 1):
            on = [f"m.attr_num = {fix.attrs[a]}", f"m.level = {level}", f"m.attr_value = s.{a}"]
            on += [f"m.parent{i} = s.{p}" for i, p in enumerate(ps[:level], start=1)]
            parts.append(
                f"select s.row_id, {fix.attrs[a]} as attr_num, '{a}' as attr_name, {level} as level, m.class, m.n, "
                f"m.parents_count, m.num_values from s join model m on {' and '.join(on)}"
            )
    return [
        *ctes,
        ("s", rows_sql),
        ("matches", " union all ".join(parts)),
        ("deepest", "select * from matches qualify level = max(level) over (partition by row_id, attr_num)"),
    ]


def score_ctes(*args, include_prior: bool = True, **kwargs) -> list[tuple[str, str]]:
    prior = "ln((yc.n + 1e0 / (select count(*) from yc)) / ((select sum(n) from yc) + 1e0))"
    if include_prior:
        scores = f"""
  select s.row_id, yc.class, {prior} + coalesce(e.score, 0.0) as log_score
  from s cross join yc left join evid e on e.row_id = s.row_id and e.class = yc.class"""
    else:
        scores = "select row_id, class, score as log_score from evid"
    return [
        *match_ctes(*args, **kwargs),
        ("evid", f"select row_id, class, sum({LOG_PROB}) as score from deepest group by row_id, class"),
        ("scores", scores),
        (
            "probs",
            """
  select row_id, class, weight / sum(weight) over (partition by row_id) as prob
  from (select row_id, class, exp(log_score - max(log_score) over (partition by row_id)) as weight from scores) t""",
        ),
    ]


# --- leave one out -----------------------------------------------------------


def loocv_ctes(fix: Fixture, parents_of: Mapping[str, Sequence[str]], joint: bool) -> list[tuple[str, str]]:
    k = width(parents_of)
    ps = ", ".join(f"parent{i}" for i in range(1, k + 1))
    parts = []
    for a, its in parents_of.items():
        joins, columns = [], []
        for level in range(k + 1):
            if level <= len(its):
                on = [f"c{level}.attr_num = {fix.attrs[a]}", f"c{level}.level = {level}", f"c{level}.attr_value = f.{a}"]
                on += [f"c{level}.parent{i} = f.{p}" for i, p in enumerate(its[:level], start=1)]
                if level:
                    on.append(f"c{level}.class = c0.class")
                joins.append(f"join cell c{level} on {' and '.join(on)}")
                columns.append(f"c{level}.n as n{level}, c{level}.parents_count as t{level}, c{level}.support as s{level}")
            else:
                columns.append(f"0 as n{level}, 0 as t{level}, 0 as s{level}")
        parts.append(f"select f.row_id, f.y, c0.class, c0.num_values, {', '.join(columns)} from f {' '.join(joins)}")
    ks = []
    for depth in range(k + 1):
        n, t = "n0", "t0"
        for level in range(1, depth + 1):
            chain = " and ".join(f"s{i} >= 2" for i in range(1, level + 1))
            n, t = f"case when {chain} then n{level} else {n} end", f"case when {chain} then t{level} else {t} end"
        ks.append(f"select row_id, y, class, num_values, {depth} as k, {n} as n, {t} as t from per_attr")
    total = "yc.n" if joint else "u.t"
    return [
        *model_ctes(fix, parents_of),
        ("cell", f"select *, sum(n) over (partition by attr_num, level, attr_value, {ps}) as support from model"),
        ("per_attr", " union all ".join(parts)),
        ("used", " union all ".join(ks)),
        (
            "loocv",
            f"""
  select u.row_id, u.y as {fix.label}, u.k, u.class,
         sum(ln((u.n - (u.y = u.class)::int + 1e0 / u.num_values) / ({total} - (u.y = u.class)::int + 1e0)))
         + any_value(ln((yc.n - (u.y = u.class)::int + 1e0 / (select count(*) from yc)) / (select sum(n) from yc))) as log_score
  from used u join yc on yc.class = u.class
  group by u.row_id, u.y, u.k, u.class""",
        ),
    ]


# --- learn and score, with the structure found by SQL itself ------------------


def learned_score_ctes(fix: Fixture, k: int) -> list[tuple[str, str]]:
    """Structure, parameters and probabilities for any structure the data gives.

    Rows are unpivoted, so parents are looked up by name and no level is
    written out by hand. ``fix.base`` must have ``row_id``. Covers k = 2.
    """
    unpivot = " union all ".join(f"select row_id, y, '{a}' as attr, {a} as val from f" for a in fix.attrs)
    keys = "attr, lvl, val, v1, v2"
    return [
        *structure_ctes(fix, k),
        ("l", unpivot),
        (
            "par",
            """select attr_name as attr, num_values, max(case when cmi_rank = 1 then parent end) as p1,
                      max(case when cmi_rank = 2 then parent end) as p2
               from structure where mi_rank is not null group by attr_name, num_values""",
        ),
        (
            "ev",
            """select l.row_id, l.y, l.attr, l.val, par.num_values, a.val as v1, b.val as v2
               from l join par on par.attr = l.attr
               left join l a on a.row_id = l.row_id and a.attr = par.p1
               left join l b on b.row_id = l.row_id and b.attr = par.p2""",
        ),
        (
            "lev",
            """select row_id, y, attr, num_values, 0 as lvl, val, '' as v1, '' as v2 from ev
               union all select row_id, y, attr, num_values, 1, val, v1, '' from ev where v1 is not null
               union all select row_id, y, attr, num_values, 2, val, v1, v2 from ev where v2 is not null""",
        ),
        ("cnt", f"select {keys}, y as class, count(*) as n from lev group by {keys}, y"),
        ("tot_path", "select attr, lvl, v1, v2, class, sum(n) as t from cnt group by attr, lvl, v1, v2, class"),
        ("deep", "select * from lev qualify lvl = max(lvl) over (partition by row_id, attr)"),
        (
            "evid",
            """select d.row_id, yc.class, sum(ln(greatest((coalesce(c.n, 0) + 1e0 / d.num_values) / (coalesce(t.t, 0) + 1e0), 1e-75))) as score
               from deep d cross join yc
               left join cnt c on c.attr = d.attr and c.lvl = d.lvl and c.val = d.val and c.v1 = d.v1 and c.v2 = d.v2 and c.class = yc.class
               left join tot_path t on t.attr = d.attr and t.lvl = d.lvl and t.v1 = d.v1 and t.v2 = d.v2 and t.class = yc.class
               group by d.row_id, yc.class""",
        ),
        (
            "scores",
            """select e.row_id, e.class,
                      e.score + ln((yc.n + 1e0 / (select count(*) from yc)) / ((select sum(n) from yc) + 1e0)) as log_score
               from evid e join yc on yc.class = e.class""",
        ),
        (
            "probs",
            """select row_id, class, exp(log_score - peak) / sum(exp(log_score - peak)) over (partition by row_id) as prob
               from (select *, max(log_score) over (partition by row_id) as peak from scores) t""",
        ),
    ]
