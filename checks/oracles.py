"""DuckDB SQL for every query whose result SQL can state, over the same sample tables."""
from __future__ import annotations

import re

from tremorline.operators.report import DRIVER_TEXTS, driver_parts
from tremorline.schemas import AUTHORSHIP_FEATURES, CHURN_FEATURES, COUPLING_FEATURES, FEATURES

# Code extensions and bug-fix words, as in the package.
EXT = "case p_size % 5 when 0 then '.py' when 1 then '.js' when 2 then '.GO' when 3 then '.md' else '' end"
PATH = f"'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || {EXT}"
CODE = "'.py','.js','.ts','.tsx','.jsx','.java','.go','.rs','.rb','.c','.cpp','.h','.hpp','.cs','.kt','.swift'"
BUGFIX = (
    r"coalesce(regexp_matches(message, '(?i)\b(?:fix(?:e[ds])?|bug|error|defect|patch|issue|crash|fault|"
    r"repair|resolve[ds]?|hotfix)\b'), false)"
)
SUFFIX = r"lower(regexp_extract(file_path, '[^/](\.[^./]+)$', 1))"


def _windows() -> str:
    parts = []
    for d in (30, 60, 90):
        inside = f"commit_date >= ref_date - interval {d} day"
        parts.append(f"cast(coalesce(sum(lines) filter (where {inside}), 0) as bigint) as lines_changed_{d}d")
        parts.append(f"count(*) filter (where {inside}) as commit_count_{d}d")
    return ", ".join(parts)


def _churn(touches: str, bounds: str) -> str:
    return f"""select *, case when lines_changed_90d > 0
            then lines_changed_30d / (lines_changed_90d / 3.0::double) else 1.0::double end as churn_spike_ratio
        from (select repo, file_path, {_windows()}, count(*) as total_commits,
                cast(coalesce(sum(lines), 0) as bigint) as total_lines_changed,
                (epoch_us(any_value(ref_date)) - epoch_us(min(commit_date))) // 86400000000 as file_age_days,
                (epoch_us(any_value(ref_date)) - epoch_us(max(commit_date))) // 86400000000 as days_since_last_change
              from {touches} join {bounds} using (repo) group by repo, file_path)"""


def _touches(facts: str) -> str:
    return f"""select repo, file_path, commit_hash, min(commit_date) as commit_date, min(author_name) as author_name,
        bool_or({BUGFIX}) as is_bugfix, count(*) as n_rows, sum(lines_added + lines_deleted) as lines
        from {facts} group by repo, file_path, commit_hash"""


def _bounds(facts: str) -> str:
    return f"""select repo, ref_date, ref_date - interval 6 month as cutoff,
        ref_date - interval 6 month + interval 30 day as label_end
        from (select repo, max(commit_date) as ref_date from {facts} group by repo)"""


def _authors(touches: str, bounds: str) -> str:
    return f"""with n as (select repo, file_path, author_name, count(*) as c, max(commit_date) as last_change
            from {touches} where author_name is not null group by all),
        p as (select *, c / sum(c) over (partition by repo, file_path) as share from n join {bounds} using (repo))
        select repo, file_path, count(*) as unique_authors_total,
            count(*) filter (where last_change >= ref_date - interval 30 day) as unique_authors_30d,
            max(share) as bus_factor_score,
            greatest(0.0, -sum(share * log2(share + 1e-12))) as author_entropy
        from p group by repo, file_path"""


def _pairs(limit: int) -> str:
    return f"""select a.repo, a.file_path as f1, b.file_path as f2, count(*) as n_commits,
            min(a.commit_hash) as first_commit
        from touches a join touches b on a.repo = b.repo and a.commit_hash = b.commit_hash and a.file_path < b.file_path
        join sizes s on s.repo = a.repo and s.commit_hash = a.commit_hash
        where s.n_rows <= {limit} group by all"""


def _edges(pairs: str) -> str:
    return f"""select repo, f1 as file_path, f2 as partner, n_commits, first_commit from {pairs}
        union all select repo, f2, f1, n_commits, first_commit from {pairs}"""


def _nearest(edges: str) -> str:
    return f"""select *, row_number() over (partition by repo, file_path
            order by n_commits desc, first_commit, partner) as position
        from {edges} qualify position <= 5"""


def _coupling(edges: str, nearest: str) -> str:
    return f"""with m as (select repo, file_path, max(n_commits) as top, count(*) as partners from {edges} group by all),
        t as (select n.repo, n.file_path, avg(n_commits) as mean_commits,
                max(case when position <= 3 and h.file_path is not null then 1 else 0 end) as hot
            from {nearest} n left join high_churn h on h.repo = n.repo and h.file_path = n.partner group by all),
        c as (select repo, count(*) as total from sizes group by repo)
        select repo, file_path, coalesce(mean_commits / total, 0.0) as coupling_score_mean,
            coalesce(top / total, 0.0) as coupling_score_max, cast(coalesce(hot, 0) as bigint) as coupled_high_churn,
            coalesce(partners, 0) as unique_coupling_partners
        from files join c using (repo) left join m using (repo, file_path) left join t using (repo, file_path)"""


def _driver_case() -> str:
    branches = []
    for name, template in DRIVER_TEXTS.items():
        before, decimals, after = driver_parts(template)
        number = "" if decimals is None else f" || printf('%.{decimals}f', value)"
        branches.append(f"when '{name}' then '{before}'{number} || '{after}'")
    return "case feature " + " ".join(branches) + " end"


def _contribution_rows() -> str:
    rows = " union all ".join(
        f"select repo, file_path, {at} as idx, '{name}' as feature, cast({name} as double) as value from matrix"
        for at, name in enumerate(FEATURES)
    )
    return f"""select *, ((cast(floor(round(value, 6) * 16) as bigint) * (idx + 3)) % 41 - 20) / 16.0::double as phi
        from ({rows})"""


RESULT_SCORE = "cast(printf('%.1f', probability * 100) as double)"

CTES = {
    "records": f"""select 'repo' || (o_orderkey % 3) as repo, lpad(cast(o_orderkey as varchar), 10, '0') as commit_hash,
        o_orderdate as commit_date, o_orderkey % 13 = 0 as is_merge, 'author' || (o_custkey % 50) as author_name,
        case o_orderpriority when '1-URGENT' then 'Fixed crash in module' when '2-HIGH' then 'bugs cleanup'
            when '3-MEDIUM' then 'prefix tidy' when '4-NOT SPECIFIED' then null else 'Add feature' end as message,
        {PATH} as old_path, case when l_returnflag = 'R' and l_linenumber = 7 then null else {PATH} end as new_path,
        cast(l_quantity as bigint) as lines_added, cast(round(l_discount * 100) as bigint) as lines_deleted
        from orders left join lineitem on o_orderkey = l_orderkey left join part on p_partkey = l_partkey""",
    "facts": """select repo, commit_hash, commit_date, author_name, message, coalesce(new_path, old_path) as file_path,
        lines_added, lines_deleted from records where not is_merge and coalesce(new_path, old_path) is not null""",
    "touches": _touches("facts"),
    "bounds": _bounds("facts"),
    "sizes": "select repo, commit_hash, count(*) as n_rows from facts group by all",
    "files": "select distinct repo, file_path from facts",
    "churn": _churn("touches", "bounds"),
    "authors": _authors("touches", "bounds"),
    "event_facts": """select 'repo' || (event_id % 3) as repo, lpad(cast(event_id as varchar), 10, '0') as commit_hash,
        ts as commit_date, cast(user_id as varchar) as author_name, event_type as message,
        'k' || json_extract_string(props, '$.k') || '.py' as file_path, cast(floor(value) as bigint) as lines_added,
        0::bigint as lines_deleted from events""",
    "event_touches": _touches("event_facts"),
    "event_bounds": _bounds("event_facts"),
    "event_churn": _churn("event_touches", "event_bounds"),
    "event_authors": _authors("event_touches", "event_bounds"),
    "old_facts": "select * from facts where commit_date < timestamp '2000-01-01'",
    "old_touches": _touches("old_facts"),
    "old_bounds": _bounds("old_facts"),
    "old_churn": _churn("old_touches", "old_bounds"),
    "pairs": _pairs(30),
    "small_pairs": _pairs(8),
    "edges": _edges("pairs"),
    "small_edges": _edges("small_pairs"),
    "nearest": _nearest("edges"),
    "small_nearest": _nearest("small_edges"),
    "thresholds": """select repo, quantile_cont(cast(total_lines_changed as double), 0.75) as threshold
        from churn group by repo""",
    "high_churn": """select repo, file_path from churn join thresholds using (repo)
        where total_lines_changed >= threshold""",
    "coupling": _coupling("edges", "nearest"),
    "small_coupling": _coupling("small_edges", "small_nearest"),
    "measured": f"""select repo, {PATH} as file_path, case p_partkey % 4 when 0 then 1 + p_size % 50
            when 1 then ((p_size % 50 + 3) // 2 + 1 + 1 + p_size % 50 + 1) / 3.0::double
            when 2 then (10 + 1 + p_size % 50) / 2.0::double else 0 end::double as cyclomatic_complexity
        from part, (values ('repo0'), ('repo1'), ('repo2')) r(repo) where p_size % 5 = 0 and p_size <> 50""",
    "complexity": """select repo, file_path, coalesce(m.cyclomatic_complexity, 0.0) as cyclomatic_complexity,
        (case when coalesce(m.cyclomatic_complexity, 0) <= 5 then 1 when m.cyclomatic_complexity <= 10 then 2
            when m.cyclomatic_complexity <= 20 then 3 when m.cyclomatic_complexity <= 30 then 4
            when m.cyclomatic_complexity <= 40 then 5 else 6 end)::bigint as complexity_rank,
        (coalesce(m.cyclomatic_complexity, 0) > 10)::bigint as is_high_complexity
        from files left join measured m using (repo, file_path)""",
    "flags": """select repo, file_path, max(case when is_bugfix and commit_date >= cutoff and commit_date < label_end
            then 1 else 0 end)::bigint as label,
        bool_or(commit_date < cutoff) as in_train, bool_or(commit_date >= cutoff) as in_test
        from touches join bounds using (repo) group by repo, file_path""",
    "matrix": f"""select repo, file_path, {', '.join(FEATURES)}, label, in_train, in_test
        from churn join coupling using (repo, file_path) join authors using (repo, file_path)
        join complexity using (repo, file_path) join flags using (repo, file_path)""",
    "predictions": """select repo, file_path,
        ((total_lines_changed * 7 + file_age_days * 3 + total_commits) % 1000) / 1000.0::double as probability
        from churn""",
    "results": f"select repo, file_path, {RESULT_SCORE} as risk_score from predictions",
    "contributions": _contribution_rows(),
    "drivers": f"""select repo, file_path, string_agg(driver, ' | ' order by abs(phi) desc, idx desc) as top_drivers
        from (select *, {_driver_case()} as driver from contributions
            qualify row_number() over (partition by repo, file_path order by abs(phi) desc, idx desc) <= 3)
        group by repo, file_path""",
    "details": """select repo, file_path, risk_score, coalesce(top_drivers, '') as top_drivers, total_commits,
        commit_count_30d as churn_30d, cast(printf('%.4f', bus_factor_score) as double) as bus_factor_score,
        cast(printf('%.4f', coupling_score_max) as double) as coupling_score_max
        from results join matrix using (repo, file_path) left join drivers using (repo, file_path)""",
    "scores": """select 'toxic' || toxic as repo, quality as y, round(n_chars / 20000.0::double, 2) as score
        from labels join documents using (doc_id)""",
    "curve": """select *, sum(pos) over w as tp, sum(neg) over w as fp,
            sum(pos) over (partition by repo) as p, sum(neg) over (partition by repo) as n
        from (select repo, score, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg
              from scores group by all)
        window w as (partition by repo order by score desc rows unbounded preceding)""",
    "measures": """select repo, sum(neg * (tp - pos / 2.0::double)) / (max(p) * max(n)) as auc_roc,
            sum(pos * tp / (tp + fp)) / max(p) as avg_precision, max(p) as p,
            coalesce(sum(pos) filter (where score >= 0.5), 0) as tp, coalesce(sum(neg) filter (where score >= 0.5), 0) as fp
        from curve group by repo""",
    "confusion": """select repo, count(*) filter (where y = 1 and score >= 0.5) as tp,
            count(*) filter (where y = 0 and score >= 0.5) as fp, count(*) filter (where y = 1 and score < 0.5) as fn,
            count(*) filter (where y = 0 and score < 0.5) as tn from scores group by repo""",
    "per_class": """select repo, '1' as label, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
            case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
            case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, tp + fn as support
        from confusion
        union all select repo, '0', case when tn + fn > 0 then tn / (tn + fn) else 0 end,
            case when tn + fp > 0 then tn / (tn + fp) else 0 end,
            case when 2 * tn + fp + fn > 0 then 2 * tn / (2 * tn + fp + fn) else 0 end, tn + fp from confusion""",
    "stamped": """select repo, file_path, total_lines_changed, timestamp '2024-03-01'
        - to_seconds(total_lines_changed * 400 % 172800) as computed_at from churn""",
}

# The two small trees of the queries: (value, tests), a test being feature, condition and share of the training weight.
_TREES = [
    (-0.625, [("total_commits", "<= 9", 0.5)]),
    (0.375, [("total_commits", "> 9", 0.5), ("bus_factor_score", "<= 0.1875", 0.75)]),
    (0.875, [("total_commits", "> 9", 0.5), ("bus_factor_score", "> 0.1875", 0.25)]),
    (-0.1875, [("file_age_days", "<= 1500", 0.375)]),
    (0.3125, [("file_age_days", "> 1500", 0.625)]),
]


def _met(test: tuple) -> str:
    return f"(case when {test[0]} {test[1]} then 1 else 0 end)::double"


def _phi(feature: str) -> str:
    """Shapley value of a feature: of a leaf with one test, or with two the mean over the other known and unknown."""
    terms = []
    for value, tests in _TREES:
        for at, test in enumerate(tests):
            if test[0] == feature:
                other = [t for k, t in enumerate(tests) if k != at]
                rest = f" * ({_met(other[0])} + {other[0][2]}) / 2" if other else ""
                terms.append(f"({value}) * ({_met(test)} - {test[2]}){rest}")
    return " + ".join(terms) or "0.0::double"


CTES["leaf_scores"] = f"""select repo, file_path, label as y, 1 / (1 + exp(-2 * ({' + '.join(
    f"({value}) * {' * '.join(map(_met, tests))}" for value, tests in _TREES)}))) as probability, probability as score
    from matrix where in_test"""
CTES["leaf_contributions"] = " union all ".join(
    f"select repo, file_path, {at} as idx, '{name}' as feature, cast({name} as double) as value, {_phi(name)} as phi from matrix where in_test"
    for at, name in enumerate(FEATURES))
CTES["leaf_drivers"] = CTES["drivers"].replace("from contributions", "from leaf_contributions")
CTES["leaf_curve"] = CTES["curve"].replace("from scores", "from leaf_scores")
CTES["leaf_measures"] = CTES["measures"].replace("from curve", "from leaf_curve")
CTES["leaf_details"] = f"""select repo, file_path, {RESULT_SCORE} as risk_score, coalesce(top_drivers, '') as top_drivers, total_commits,
    commit_count_30d as churn_30d, cast(printf('%.4f', bus_factor_score) as double) as bus_factor_score,
    cast(printf('%.4f', coupling_score_max) as double) as coupling_score_max
    from leaf_scores join matrix using (repo, file_path) left join leaf_drivers using (repo, file_path)"""
CTES["boost_0"] = """select repo, file_path, c as x0, a as x1, y, case when y then 2.0::double else 1.0::double end as w, 0.0::double as margin
    from (select repo, file_path, least(total_commits, 20) as c, file_age_days // 100 as a,
        (least(total_commits, 20) >= 10) != ((file_age_days // 100) % 7 = 3) as y from churn)"""
for _round in range(2):
    # Gradients in whole 2^-24, then for each of two levels the split of most gain in every node, lowest feature and limit first.
    CTES[f"boost_{_round}_0"] = f"""select *, 0 as node, floor(w * (p - y::int) * 16777216 + 0.5)::bigint as g, floor(w * p * (1 - p) * 16777216 + 0.5)::bigint as h
        from (select *, 1 / (1 + exp(-2 * margin)) as p from boost_{_round})"""
    for _level in range(2):
        CTES[f"boost_{_round}_{_level + 1}"] = f"""select r.* exclude (node),
            case when s.node is null then r.node else 2 * r.node + 1 + (case s.f when 0 then x0 else x1 end > s.v)::int end as node
            from boost_{_round}_{_level} r left join (
              select node, f, v from (
                select *, lg * lg / (lh + 1) + (ag - lg) * (ag - lg) / (ah - lh + 1) - ag * ag / (ah + 1) as gain from (
                  select node, f, v, (sum(g) over o)::double / 16777216 as lg, (sum(h) over o)::double / 16777216 as lh,
                    (sum(g) over a)::double / 16777216 as ag, (sum(h) over a)::double / 16777216 as ah from (
                    select node, f, v, sum(g) as g, sum(h) as h from (
                      select node, 0 as f, x0 as v, g, h from boost_{_round}_{_level} union all select node, 1, x1, g, h from boost_{_round}_{_level})
                    group by all)
                  window o as (partition by node, f order by v), a as (partition by node, f)))
              where lh >= 1 and ah - lh >= 1 and gain > 1e-9
              qualify row_number() over (partition by node order by gain desc, f, v) = 1) s on s.node = r.node"""
    CTES[f"boost_{_round + 1}"] = f"""select repo, file_path, x0, x1, y, w,
        margin - 0.05 * ((sum(g) over n)::double / 16777216) / ((sum(h) over n)::double / 16777216 + 1) / 2 as margin
        from boost_{_round}_2 window n as (partition by node)"""
CTES["rounds"] = """select (o_orderkey % 3)::varchar as repo, (o_orderkey % 60)::int as tree_id,
    (sum(o_custkey) % 997)::double / 997.0::double as auc_roc from orders group by all"""

_NAMES = "|".join(sorted(CTES, key=len, reverse=True))


def _needs(sql: str) -> set[str]:
    return set(re.findall(rf"(?:from|join)\s+\(?({_NAMES})\b", sql))


def _with(sql: str) -> str:
    needed, pending = set(), _needs(sql)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending |= _needs(CTES[name])
    parts = ", ".join(f"{name} as materialized ({body})" for name, body in CTES.items() if name in needed)
    return f"with {parts} {sql}" if parts else sql


def _rounded(names: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({n}, 6) as {n}" if n in doubles else n for n in names)


_DOUBLES = {"churn_spike_ratio", "coupling_score_mean", "coupling_score_max", "bus_factor_score", "author_entropy",
            "cyclomatic_complexity"}
_K = "repo, file_path, "


def _features(names: list[str], source: str) -> str:
    return f"select {_K}{_rounded(names, _DOUBLES)} from {source}"


_RECORD_COLUMNS = """repo, commit_hash, epoch_us(commit_date) as commit_date, is_merge, author_name, message, old_path,
    new_path, coalesce(lines_added, -1) as lines_added, coalesce(lines_deleted, -1) as lines_deleted"""
_FACT_COLUMNS = f"""repo, commit_hash, epoch_us(commit_date) as commit_date, author_name, message, file_path, lines_added,
    lines_deleted, {SUFFIX} in ({CODE}) as is_code_file"""
_LATEST = """(select repo, commit_hash from (select distinct repo, commit_hash, commit_date from records where not is_merge)
    qualify row_number() over (partition by repo order by commit_date desc, commit_hash desc) <= 1000)"""
_COLOUR = "case when risk_score < 40 then '#3fb950' when risk_score < 70 then '#d29922' else '#f85149' end"
_SHORT = r"regexp_extract(file_path, '([^/]+/)?[^/]+$')"
_TRIMMED = r"regexp_replace(regexp_replace(url, '/+$', ''), '\.git$', '')"
_ONE = r"regexp_replace(url, '/$', '')"

ORACLES = {name: _with(sql) for name, sql in {
    "read_change_records": f"select {_RECORD_COLUMNS} from records",
    "read_change_records_csv": "select " + _RECORD_COLUMNS.replace(
        " message,", " coalesce(message, 'none') || ', first line~said \"fix\", twice \"\"~~end' as message,").replace(
        "', first line~said \"fix\", twice \"\"~~end'", "replace(', first line~said \"fix\", twice \"\"~~end', '~', chr(10))") + " from records",
    "refresh_results": "select repo, file_path, case when repo = 'repo2' then risk_score else -1 end as risk_score from results",
    "read_source_files": f"""select repo, {PATH} as file_path, case when p_size = 50 then 'def (:' else
        replace(case p_partkey % 4
            when 0 then 'def f(x):~    pass~' || repeat('    if x:~        pass~', p_size % 50)
            when 1 then 'class A:~    def m(self, x):~        pass~' || repeat('        if x:~            pass~', p_size % 50)
                || '    def n(self):~        return self~'
            when 2 then 'def g(x):~    for a in x:~        pass~    else:~        pass~    try:~        pass~    except E:~        pass~    else:~'
                || '        pass~    while x and a or x:~        pass~    return [b for b in x if b]~'
                || 'def f(x):~    pass~' || repeat('    if x:~        pass~', p_size % 50)
            else 'import os~x = 1 if os else 2~' end, '~', chr(10)) end as source
        from part, (values ('repo0'), ('repo1'), ('repo2')) r(repo) where p_size % 5 = 0""",
    "read_history": f"select {_FACT_COLUMNS} from facts where repo in ('repo0', 'repo2')",
    "write_results": "select *, epoch_us(timestamp '2024-03-01') as computed_at from results",
    "fresh_results": """select repo, file_path, total_lines_changed, epoch_us(computed_at) as computed_at from stamped
        where total_lines_changed * 400 % 172800 < 86400""",
    "stale_repos": "select distinct repo from facts where cast(substr(repo, 5, 1) as int) * 12 * 3600 >= 86400",
    "non_merge_changes": f"select {_RECORD_COLUMNS} from records where not is_merge",
    "resolve_path": """select repo, commit_hash, coalesce(new_path, old_path) as file_path from records
        where coalesce(new_path, old_path) is not null""",
    "code_file_flag": f"select distinct repo, file_path, {SUFFIX} in ({CODE}) as is_code_file from facts",
    "utc_commit_date": """select o_orderkey, epoch_us(case when o_orderkey % 2 = 0 then o_orderdate - interval 2 hour
        else o_orderdate end) as commit_date from orders""",
    "commit_file_rows": f"select {_FACT_COLUMNS} from facts",
    "latest_commits": f"select {_RECORD_COLUMNS} from records where (repo, commit_hash) in {_LATEST}",
    "label_bugfix": f"select distinct repo, commit_hash, message, {BUGFIX} as is_bugfix from facts",
    "label_bugfix_events": f"select repo, commit_hash, {BUGFIX} as is_bugfix from event_facts",
    "lines_changed": "select repo, commit_hash, file_path, lines_added + lines_deleted as lines_changed from facts",
    "history_bounds": """select repo, epoch_us(ref_date) as ref_date, epoch_us(cutoff) as cutoff,
        epoch_us(label_end) as label_end from bounds""",
    "history_order": f"select {_FACT_COLUMNS} from facts order by facts.commit_date, repo, commit_hash, file_path",
    "anchor_to_ref": """select repo, commit_hash, file_path, epoch_us(ref_date) as ref_date, epoch_us(cutoff) as cutoff
        from facts join bounds using (repo)""",
    "dedupe_commit_file": """select repo, file_path, commit_hash, epoch_us(commit_date) as commit_date, author_name
        from touches""",
    "enough_history": f"""select {_FACT_COLUMNS}, {BUGFIX} as is_bugfix from event_facts
        where repo in (select repo from event_facts group by repo having count(*) >= 3300)""",
    "short_history": """select repo, count(*) as n_rows, 'not enough history: fewer than 3334 rows' as reason
        from event_facts group by repo having count(*) < 3334""",
    "history_summary": """select repo, count(*) as total_commits, count(*) filter (where b) as bugfix_commits,
        round(count(*) filter (where b) / count(*) * 100, 6) as bugfix_pct
        from (select repo, commit_hash, bool_or(is_bugfix) as b from touches group by all) group by repo""",
    "top_bugfix_files": """select repo, file_path, count(*) as bugfix_commits,
        row_number() over (partition by repo order by count(*) desc, file_path) as position
        from touches where is_bugfix group by repo, file_path qualify position <= 10""",
    "repo_slug": f"""select page_id, split_part({_TRIMMED}, '/', -2) as owner, split_part({_TRIMMED}, '/', -1) as name,
        split_part({_TRIMMED}, '/', -2) || '_' || split_part({_TRIMMED}, '/', -1) as slug,
        case when split_part({_ONE}, '/', -2) <> '' and split_part({_ONE}, '/', -1) <> ''
            then split_part({_ONE}, '/', -2) || ' / ' || split_part({_ONE}, '/', -1) else url end as display
        from pages""",
    "shorten_path": f"select distinct file_path, {_SHORT} as label from facts",
    "risk_band": f"""select repo, file_path, risk_score,
        case when risk_score < 40 then 'LOW' when risk_score < 70 then 'MED' else 'HIGH' end as band,
        {_COLOUR} as colour, risk_score >= 80 as is_critical from results""",
    "risk_score": "select * from results",
    "driver_text": f"select repo, file_path, feature, {_driver_case()} as driver from contributions",
    "churn_windows": _features(CHURN_FEATURES[:6], "churn"),
    "churn_spike": _features(["churn_spike_ratio"], "churn"),
    "lifetime_activity": _features(CHURN_FEATURES[7:], "churn"),
    "churn_features": _features(CHURN_FEATURES, "churn"),
    "churn_features_as_of": _features(CHURN_FEATURES, "old_churn"),
    "churn_features_events": _features(CHURN_FEATURES, "event_churn"),
    "author_counts": "select repo, file_path, author_name, count(*) as n_commits from touches group by all",
    "unique_authors": _features(AUTHORSHIP_FEATURES[:2], "authors"),
    "bus_factor": _features(["bus_factor_score"], "authors"),
    "author_entropy": _features(["author_entropy"], "authors"),
    "authorship_features": _features(AUTHORSHIP_FEATURES, "authors"),
    "authorship_features_events": _features(AUTHORSHIP_FEATURES, "event_authors"),
    "mass_commit_filter": "select * from sizes where n_rows <= 8",
    "mass_commit_report": """select repo, count(*) as total_commits, count(*) filter (where n_rows > 8) as skipped_commits
        from sizes group by repo""",
    "co_change_pairs": "select repo, f1, f2, n_commits from pairs",
    "co_change_pairs_small": "select repo, f1, f2, n_commits from small_pairs",
    "partner_edges": "select repo, file_path, partner, n_commits from small_edges",
    "top_partners": "select repo, file_path, partner, n_commits, position from nearest",
    "churn_threshold": "select repo, round(threshold, 6) as threshold from thresholds",
    "high_churn_files": "select repo, file_path from high_churn",
    "coupled_high_churn": """select repo, file_path, coupled_high_churn from small_coupling
        where unique_coupling_partners > 0""",
    "coupling_features": _features(COUPLING_FEATURES, "coupling"),
    "coupling_features_small": _features(COUPLING_FEATURES, "small_coupling"),
    "file_complexity": _features(["cyclomatic_complexity"], "measured"),
    "complexity_grade": """select repo, file_path, (case when cyclomatic_complexity <= 5 then 1
        when cyclomatic_complexity <= 10 then 2 when cyclomatic_complexity <= 20 then 3
        when cyclomatic_complexity <= 30 then 4 when cyclomatic_complexity <= 40 then 5 else 6 end)::bigint
        as complexity_rank, (cyclomatic_complexity > 10)::bigint as is_high_complexity from measured""",
    "complexity_left": _features(["cyclomatic_complexity", "complexity_rank", "is_high_complexity"], "complexity"),
    "complexity_features": _features(["cyclomatic_complexity", "complexity_rank", "is_high_complexity"], "complexity"),
    "feature_matrix": "select repo, file_path, " + ", ".join(
        [f"coalesce(round(c.{n}, 6), 0) as {n}" if n in _DOUBLES else f"coalesce(c.{n}, 0)::bigint as {n}"
         for n in CHURN_FEATURES]
        + [f"coalesce(round(a.{n}, 6), 0) as {n}" if n in _DOUBLES else f"coalesce(a.{n}, 0)::bigint as {n}"
           for n in AUTHORSHIP_FEATURES]
    ) + """, coalesce(round(x.cyclomatic_complexity, 6), 0) as cyclomatic_complexity,
        greatest(coalesce(x.complexity_rank, 0), 1)::bigint as complexity_rank,
        coalesce(x.is_high_complexity, 0)::bigint as is_high_complexity
        from (select * from churn where total_commits % 2 = 0) c
        full join (select * from authors where unique_authors_total % 3 > 0) a using (repo, file_path)
        full join (select * from complexity where complexity_rank > 1) x using (repo, file_path)""",
    "canonical_features": _features(CHURN_FEATURES + AUTHORSHIP_FEATURES, "churn join authors using (repo, file_path)"),
    "label_files": "select repo, file_path, label from flags",
    "temporal_split": "select repo, file_path, in_train, in_test from flags",
    "split_report": """select repo, count(*) filter (where in_train) as train_files,
        round(coalesce(avg(label) filter (where in_train), 0), 6) as train_pos_rate,
        count(*) filter (where in_test) as test_files,
        round(coalesce(avg(label) filter (where in_test), 0), 6) as test_pos_rate,
        count(*) filter (where in_test) > 0 and count(*) filter (where in_test and label = 1) = 0 as no_test_positives
        from flags group by repo""",
    "build_feature_matrix": _features([*FEATURES, "label", "in_train", "in_test"], "matrix"),
    "matrix_from_history": _features([*FEATURES, "label", "in_train", "in_test"], "matrix"),
    "score_curve": "select repo, score, tp::bigint as tp, fp::bigint as fp from curve",
    "roc_auc": "select repo, round(auc_roc, 6) as auc_roc from measures",
    "average_precision": "select repo, round(avg_precision, 6) as avg_precision from measures",
    "pr_curve": """select repo, score as threshold, round(tp / p, 6) as recall, round(tp / (tp + fp), 6) as precision,
            round(p / (p + n), 6) as no_skill from curve where p > 0 and n > 0
        union all select distinct repo, null, 0.0, 1.0, round(p / (p + n), 6) from curve where p > 0 and n > 0""",
    "evaluate_model": """select repo, round(auc_roc, 4) as auc_roc, round(avg_precision, 4) as avg_precision,
        round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 4) as threshold_05_precision,
        round(tp / p, 4) as threshold_05_recall,
        round(case when tp > 0 then 2 * tp / (tp + fp + p) else 0 end, 4) as threshold_05_f1 from measures""",
    "risk_metrics": """select repo, case when two then round(auc_roc, 4) else 0 end as auc_roc,
        case when two then round(avg_precision, 4) else 0 end as avg_precision,
        round(case when two and tp + fp > 0 then tp / (tp + fp) else 0 end, 4) as threshold_05_precision,
        round(case when two then tp / p else 0 end, 4) as threshold_05_recall,
        round(case when two and tp > 0 then 2 * tp / (tp + fp + p) else 0 end, 4) as threshold_05_f1
        from (select *, p > 0 and not isnan(auc_roc) as two from leaf_measures)""",
    "classification_report": """select repo, label, round(precision, 6) as precision, round(recall, 6) as recall,
            round(f1, 6) as f1, support from per_class
        union all select repo, 'accuracy', a, a, a, s from (select repo, round((tp + tn) / (tp + tn + fp + fn), 6) as a,
            tp + tn + fp + fn as s from confusion)
        union all select repo, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
            sum(support)::bigint from per_class group by repo
        union all select repo, 'weighted avg', round(sum(precision * support) / sum(support), 6),
            round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
            sum(support)::bigint from per_class group by repo""",
    "class_balance": """select repo, pos, neg, round(greatest(neg / greatest(pos, 1), 1.0), 6) as scale_pos_weight,
        pos > 0 and neg > 0 as trainable from (select repo, count(*) filter (where in_train and label = 1) as pos,
            count(*) filter (where in_train and label = 0) as neg from flags group by repo)""",
    "constant_fallback": "select distinct repo, file_path, 0.5::double as probability from event_facts",
    "churn_threshold_approx": "select distinct repo, true as near from churn",
    "train_model": "select repo, file_path, (margin > 0)::bigint as predicted, y::bigint as label from boost_2",
    "score_files": "select repo, file_path, round(1 / (1 + exp(-2 * margin)), 6) as probability from boost_2",
    "tree_attributions": "select repo, file_path, feature, round(value, 6) as value, round(phi, 6) as phi from leaf_contributions",
    "explain_predictions": "select * from drivers",
    "best_iteration": """select repo, (fold).tree_id::bigint as best_iteration, round((fold).auc_roc, 6) as best_auc from (
        select repo, list_reduce(list_prepend({'tree_id': -1, 'auc_roc': -1.0::double},
            list({'tree_id': tree_id, 'auc_roc': auc_roc} order by tree_id)), lambda b, r: case
                when r.auc_roc > b.auc_roc and (b.tree_id < 0 or r.tree_id - b.tree_id <= 5) then r else b end) as fold
        from rounds group by repo)""",
    "rank_risk": """select *, row_number() over (partition by repo order by risk_score desc, file_path) as rank from leaf_details""",
    "rank_files": """select *, row_number() over (partition by repo order by risk_score desc, file_path) as rank
        from results""",
    "top_drivers": "select * from drivers",
    "global_importance": """select repo, feature, round(m, 6) as mean_abs_phi,
        row_number() over (partition by repo order by m desc, idx desc) as rank
        from (select repo, feature, idx, avg(abs(phi)) as m from contributions group by all)""",
    "ranked_with_drivers": """select repo, file_path, risk_score,
        case when file_path like '%.py' then top_drivers else '' end as top_drivers,
        total_commits, churn_30d, bus_factor_score, coupling_score_max from details""",
    "file_detail": "select * from details where risk_score >= 90",
    "file_detail_by_path": f"select * from details where file_path = (select {PATH} from part where p_partkey = 0)",
    "risk_summary": """select repo, count(*) as files_analysed, count(*) filter (where risk_score >= 70) as high_risk_files
        from results group by repo""",
    "prediction_spread": """select repo, count(distinct round(probability, 3)) as distinct_probabilities,
        count(distinct round(probability, 3)) = 1 as uniform from predictions group by repo""",
    "risk_barchart_data": f"""select repo, 11 - t as position, {_SHORT} as label, risk_score, {_COLOUR} as colour
        from (select *, row_number() over (partition by repo order by risk_score desc, file_path) as t from results)
        where t <= 10""",
    "risk_treemap_data": f"select repo, file_path, {_SHORT} as label, 1::bigint as weight, risk_score from results",
}.items()}
# A refresh gives the rows of a whole run, by the same trees; repositories of one class have no model.
_KEPT = _with("""select repo, file_path, case when learns then risk_score else 50 end as risk_score, case when learns then top_drivers else '' end as top_drivers,
    total_commits, churn_30d, bus_factor_score, coupling_score_max,
    row_number() over (partition by repo order by case when learns then risk_score else 50 end desc, file_path) as rank
    from leaf_details join (select repo, bool_or(in_train and label = 1) and bool_or(in_train and label = 0) as learns from flags group by repo) using (repo)""")
ORACLES |= {"refresh_ranking": _KEPT, "refresh_from_delta": _KEPT, "refresh_metrics": ORACLES["risk_metrics"]}
# Sketches are exact for as few authors as these.
ORACLES["unique_authors_approx"] = ORACLES["unique_authors"]
