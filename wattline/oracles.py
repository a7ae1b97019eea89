"""DuckDB SQL for the registered queries, written from what the operators should return."""

from __future__ import annotations

from .functions import presets as P
from .sources import dims as D

_STATES = """
listed AS (
  SELECT l_orderkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS state
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_orderkey
)"""

_CODES = "['SUN', 'WND', 'NG', 'NUC', 'WAT', 'GEO', 'MWH', 'BAT', 'XX'][1 + o_orderkey % 9]"
_FUELS = "['solar', 'wind_onshore', 'gas', 'nuclear', 'hydro', 'geothermal', 'storage', 'storage', 'other'][1 + o_orderkey % 9]"


def _slug(name: str, key: str) -> str:
    suffix = f"regexp_replace(right({key}, 6), '[^A-Za-z0-9]', '', 'g')"
    base = f"regexp_replace(regexp_replace(lower({name}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    return f"left({base}, greatest(89 - length({suffix}), 1)::INTEGER) || '-' || {suffix}"


def _proj(shift: bool = False, name: str = "proj") -> str:
    p, o, f = ("(L) Regulatory approvals pending", "(U) Under construction", "(P) Planned") if shift else ("(P) Planned", "(L) Regulatory approvals pending", "(U) Under construction")
    stage = {"(P)": "planned_pre_filing", "(L)": "regulatory_approvals_pending", "(U)": "under_construction"}
    cases = lambda f_: " ".join(f"WHEN '{k}' THEN '{f_(v)}'" for k, v in (("P", p), ("O", o), ("F", f)))
    capacity = "round(o_totalprice / 1000 * 1.1, 6)" if shift else "o_totalprice / 1000"
    return f"""
{name} AS (
  SELECT o_orderkey AS id, c_name || ' ' || o_orderpriority AS name, CASE o_orderstatus {cases(str)} END AS status, {_CODES} AS energy_code, {_FUELS} AS fuel_type,
         CASE WHEN {_FUELS} = 'storage' THEN 'storage' ELSE 'generation' END AS project_type,
         CASE o_orderstatus {cases(lambda v: stage[v[:3]])} END AS current_stage,
         CASE WHEN o_orderkey % 11 <> 0 THEN {capacity} END AS capacity_value, CASE WHEN o_orderkey % 5 = 0 THEN 'MMcf/d' ELSE 'MW' END AS capacity_unit,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS filed, o_orderdate AS created_at, o_orderkey % 97 = 0 AS is_aggregate, {_slug("c_name || ' ' || o_orderpriority", "'orders:' || o_orderkey")} AS slug
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


_COST = "CASE fuel_type " + " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in P.COST_PER_KW.items()) + " END"
_CLEAN = "fuel_type IN (" + ", ".join(f"'{f}'" for f in P.ZERO_CARBON) + ")"
_DTO = f"""
dto AS (
  SELECT *, greatest(0, floor((epoch_ms(TIMESTAMP '2002-01-01') - epoch_ms(filed)) / 86400000))::BIGINT AS days_raw,
         CASE WHEN filed IS NOT NULL THEN greatest(0, (epoch_ms(TIMESTAMP '2002-01-01') - epoch_ms(filed)) // 86400000) END AS days,
         {_COST} AS cost, capacity_unit = 'MW' AND {_COST} IS NOT NULL AND capacity_value IS NOT NULL AS applicable
  FROM proj
)"""
_BASE = f"WITH {_proj()}, {_DTO}"
_WITH_STATE = f"WITH {_STATES}, {_proj()}, {_DTO}"
_STATS = """
SELECT count(*) AS total_projects,
       round(coalesce(sum(capacity_value) FILTER (capacity_unit = 'MW'), 0), 2) AS total_capacity_mw,
       round(coalesce(sum(capacity_value * 1000 * cost) FILTER (applicable), 0), 2) AS total_investment,
       count(*) FILTER (applicable) AS investment_count,
       round(coalesce(sum(capacity_value) FILTER (capacity_unit = 'MW' AND %s), 0), 2) AS clean_mw,
       count(capacity_value) FILTER (capacity_unit = 'MW' AND %s) AS clean_count
""" % (_CLEAN, _CLEAN)  # noqa: UP031


def _regex_cases(col: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}', 'i') THEN '{v}'" for p, v in rules) + f" ELSE '{default}' END"


def _like_cases(col: str, rules, default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({col}), '{n}')" for n in needles) + f" THEN '{v}'" for needles, v in rules) + f" ELSE '{default}' END"


def _map_cases(col: str, mapping, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


_POINTS = "MAP {" + ", ".join(f"'NATION_{i}': [{i * 3 % 50 - 100}.0::DOUBLE, {i * 7 % 20 + 30}.0::DOUBLE]" for i in range(25) if i % 6) + "}"
_CENTRES = f"""
centres AS (
  SELECT id, sum({_POINTS}[code][1]) / count({_POINTS}[code][1]) AS lon, sum({_POINTS}[code][2]) / count({_POINTS}[code][2]) AS lat, count(*) AS n
  FROM (SELECT proj.id, unnest(string_split(state, ', ')) AS code FROM proj LEFT JOIN listed ON l_orderkey = proj.id) GROUP BY id HAVING count(*) >= 2
)"""
_CELLS = "(['  NA ', '-', '', ' 1,234.5 ', '12e2', 'abc', 'NaN', ' 0 '][1 + o_orderkey % 8] || CASE WHEN o_orderkey % 16 = 3 THEN ' x' ELSE '' END)"
_FIRST = "filed < TIMESTAMP '1999-01-01'"
_SECOND = "filed >= TIMESTAMP '1997-01-01'"
_RUNS = f"""
WITH {_proj()}, {_proj(True, "shifted")},
first AS (SELECT * FROM proj WHERE {_FIRST} AND current_stage <> 'under_construction'),
second AS (SELECT * FROM shifted WHERE {_SECOND})
"""
_WORDS = "['Announced ', 'on hold', 'Approved', 'construction', 'Part Completed', 'cancelled', 'unheard of'][1 + o_orderkey % 7]"

_PIPELINES = f"""
{_BASE}, landed AS (
  SELECT *, ['Announced', 'Approved ', 'on hold', 'Construction', NULL, 'Completed', 'unheard of'][1 + id % 7] AS landed_status, CASE WHEN id % 9 <> 0 THEN 'Line ' || id ELSE 'Unnamed pipeline project' END AS title,
         ['Acme, Inc.', '', '', 'Bolt'][1 + id % 4] AS operator, CASE WHEN id % 7 <> 0 THEN floor(capacity_value * 10) END AS c FROM dto
), kept AS (
  SELECT *, CASE WHEN id % 4 = 0 THEN 'CP-' || id ELSE operator || '-' || title END AS source_id, title || CASE WHEN operator <> '' THEN ' (' || operator || ')' ELSE '' END AS full_name,
         ['planned_pre_filing', 'approved_awaiting_construction', 'agency_permitting', 'under_construction', '', 'completed', 'agency_permitting'][1 + id % 7] AS stage
  FROM landed WHERE landed_status IS NOT NULL
)"""

ORACLES: dict[str, str] = {
    "filtered_stats": f"""{_WITH_STATE} {_STATS} FROM dto LEFT JOIN listed ON l_orderkey = id
        WHERE NOT is_aggregate AND days / 365.25 >= 3 AND capacity_value >= 250 AND current_stage IN ('planned_pre_filing', 'regulatory_approvals_pending')
          AND list_contains(string_split(state, ', '), 'NATION_7')""",
    "aggregate_stats": f"{_BASE} {_STATS} FROM dto WHERE NOT is_aggregate",
    "days_years_waiting": f"{_BASE} SELECT id, days AS days_waiting, round(days / 365.25, 6) AS years_waiting FROM dto",
    "investment_waiting": f"""{_BASE} SELECT id, applicable, CASE WHEN capacity_unit <> 'MW' THEN 'unit' WHEN cost IS NULL THEN 'fuel' WHEN capacity_value IS NULL THEN 'capacity' END AS reason,
        CASE WHEN applicable THEN round(capacity_value * 1000 * cost, 2) END AS estimated_usd, CASE WHEN applicable THEN cost::DOUBLE END AS cost_per_kw FROM dto""",
    "min_years": f"{_BASE} SELECT id FROM dto WHERE days >= 0",
    "min_capacity": f"{_BASE} SELECT id FROM dto WHERE capacity_value >= 250",
    "state_contains": f"{_WITH_STATE} SELECT id FROM dto JOIN listed ON l_orderkey = id WHERE list_contains(string_split(state, ', '), 'NATION_7')",
    "any_of": f"{_BASE} SELECT id FROM dto WHERE fuel_type IN ('solar', 'gas') AND project_type = 'generation' AND current_stage = 'planned_pre_filing'",
    "tracked_only": f"{_BASE} SELECT id, current_stage FROM dto WHERE NOT is_aggregate AND current_stage <> 'under_construction'",
    "capacity_floor": f"{_BASE} SELECT id, capacity_value FROM dto WHERE capacity_value IS NULL OR capacity_value >= 250",
    "disposition_counts": f"""{_BASE}, judged AS (
          SELECT 'eia' AS source, CASE WHEN capacity_value < 250 THEN 'below_floor' ELSE 'keep' END AS disposition FROM dto
          UNION ALL SELECT 'ornlHydro', CASE WHEN capacity_value < 250 THEN 'below_floor' WHEN id % 4 <> 0 THEN 'not_waiting' ELSE 'keep' END FROM dto
          UNION ALL SELECT 'lbnl', CASE WHEN id % 3 <> 0 THEN 'not_active' WHEN contains(lower(status), 'construction') THEN 'already_cleared' WHEN capacity_value < 250 THEN 'below_floor' ELSE 'keep' END FROM dto)
        SELECT source, disposition, count(*) AS n FROM judged GROUP BY source, disposition""",
    "classify_first_match": "SELECT p_partkey, " + _regex_cases("p_name", [(r"\b1\b|red", "one"), ("1", "has_one"), ("blue|2", "two"), ("part", "part")], "other") + " AS label FROM part",
    "classify_documents": f"""SELECT doc_id, {_regex_cases("text", P.DASHBOARD_TITLE_FUEL, "other")} AS title_fuel, {_regex_cases("text", P.LBNL_RESOURCE_FUEL, "other")} AS resource_fuel,
        {_regex_cases("text", P.SOURCE_LABEL_KEY, "other")} AS source_key, {_like_cases("text", P.DASHBOARD_STAGE, "agency_permitting")} AS stage,
        {_like_cases("text", P.LBNL_STAGE, "interconnection_study")} AS phase FROM documents""",
    "code_map_override": f"""{_BASE}, coded AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'wind_offshore' WHEN id % 17 = 0 THEN 'storage' ELSE fuel_type END AS fuel_type FROM dto)
        SELECT id, fuel_type, {_CLEAN} AS zero_carbon, CASE WHEN fuel_type = 'storage' THEN 'storage' ELSE 'generation' END AS project_type FROM coded""",
    "status_stage": f"""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'P' WHEN 'O' THEN 'L' ELSE 'U' END AS code,
        CASE o_orderstatus WHEN 'P' THEN 'planned_pre_filing' WHEN 'O' THEN 'regulatory_approvals_pending' ELSE 'under_construction' END AS stage,
        {_map_cases(f"lower(trim({_WORDS}))", P.PIPELINE_STAGE, "agency_permitting")} AS pipeline_stage FROM orders""",
    "label_lookup": "SELECT c_custkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name ELSE c_nationkey::VARCHAR END AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "nest_children": """SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey), '') AS lines
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "serialize_page": f"""{_WITH_STATE} SELECT slug, name, project_type, fuel_type, state, round(capacity_value, 6) AS capacity_value, capacity_unit, current_stage,
        'interconnection_queue_backlog' AS cause_slugs, round(days / 365.25, 6) AS years_waiting, 'verified' AS verification_status
        FROM dto LEFT JOIN listed ON l_orderkey = id ORDER BY coalesce(dto.capacity_value, -1) DESC, created_at, id LIMIT 20 OFFSET 40""",
    "top_waiting": f"{_BASE} SELECT id, name, days AS days_waiting FROM dto ORDER BY coalesce(days, -1) DESC, created_at, id LIMIT 50",
    "total_matches": f"{_BASE} SELECT count(*) AS total_matches FROM dto WHERE days / 365.25 >= 5 AND fuel_type IN ('solar', 'hydro')",
    "facet_states": """SELECT DISTINCT n_name AS code, 'Nation ' || n_nationkey AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "example_project": f"{_BASE} SELECT id, name, fuel_type FROM dto WHERE NOT is_aggregate ORDER BY NOT applicable, created_at, id LIMIT 1",
    "override_keys": """SELECT 'supplier' AS source, s_suppkey::VARCHAR AS source_id,
        CASE WHEN s_suppkey % 10 = 0 THEN 'merged-' || s_suppkey ELSE 'supplier:' || s_suppkey END AS match_key FROM supplier""",
    "dedupe_first": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""",
    "upsert_snapshot": f"""{_RUNS}
        SELECT sha256(coalesce(s.slug, f.slug)) AS id, coalesce(s.slug, f.slug) AS slug, round(CASE WHEN s.slug IS NULL THEN f.capacity_value ELSE s.capacity_value END, 6) AS capacity_value,
               coalesce(s.current_stage, f.current_stage) AS current_stage, 'verified' AS verification_status,
               CASE WHEN f.slug IS NULL THEN '2001-02-01' ELSE '2001-01-01' END AS created_at, CASE WHEN s.slug IS NULL THEN '2001-01-01' ELSE '2001-02-01' END AS updated_at
        FROM first f FULL JOIN second s ON f.slug = s.slug WHERE s.slug IS NULL OR s.current_stage <> 'under_construction'""",
    "resolved_delete": f"""WITH {_proj()}, {_proj(True, "shifted")} SELECT id, slug FROM proj p WHERE {_FIRST}
        AND NOT EXISTS (SELECT 1 FROM shifted s WHERE s.slug = p.slug AND s.filed >= TIMESTAMP '1997-01-01' AND s.current_stage = 'under_construction')""",
    "replace_children": f"""{_RUNS}, kept AS (
          SELECT coalesce(s.slug, f.slug) AS slug, coalesce(s.current_stage, f.current_stage) AS stage, coalesce(s.id, f.id) AS id
          FROM first f FULL JOIN second s ON f.slug = s.slug WHERE s.slug IS NULL OR s.current_stage <> 'under_construction')
        SELECT stage, count(*) AS n, count(DISTINCT slug) AS projects FROM kept WHERE id % 3 = 0 GROUP BY stage""",
    "slugify": f"""SELECT c_custkey, {_slug("c_name || ' -- ' || c_mktsegment", "'customer:' || c_custkey")} AS slug FROM customer""",
    "slug_collisions": f"""SELECT slug, count(*) AS n, min(p_partkey) AS first_member, max(p_partkey) AS last_member
        FROM (SELECT p_partkey, {_slug("p_brand", "(p_type || '-' || p_size)")} AS slug FROM part) GROUP BY slug HAVING count(*) > 1""",
    "multi_state_centroid": f"""WITH {_STATES}, {_proj()}, {_CENTRES} SELECT proj.id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM proj LEFT JOIN centres ON centres.id = proj.id""",
    "map_points": f"""WITH {_STATES}, {_proj()}, {_CENTRES}, put AS (
          SELECT proj.id, capacity_value, capacity_unit, proj.id % 2 = 0 AND proj.id % 4 <> 3 AS site, centres.lon, centres.lat FROM proj LEFT JOIN centres ON centres.id = proj.id)
        SELECT id, CASE WHEN site THEN -90.0 ELSE round(lon, 6) END AS lon, CASE WHEN site THEN 40.0 ELSE round(lat, 6) END AS lat, NOT site AS approximate,
               round(CASE WHEN capacity_unit = 'MW' AND capacity_value IS NOT NULL THEN greatest(3.5, least(12, sqrt(capacity_value) * 0.4)) ELSE 4 END, 6) AS radius
        FROM put WHERE site OR lon IS NOT NULL""",
    "geocode_by_code": """SELECT c_custkey, CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey + 0.5::DOUBLE END AS lat, CASE WHEN c_nationkey % 4 <> 0 THEN -c_nationkey - 0.25::DOUBLE END AS lon FROM customer""",
    "clean_cells": f"""SELECT o_orderkey, CASE WHEN lower(trim({_CELLS})) NOT IN ('', 'na', '-') THEN trim({_CELLS}) END AS cell,
        CASE WHEN regexp_full_match(replace(trim({_CELLS}), ',', ''), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(replace(trim({_CELLS}), ',', '') AS DOUBLE) END AS number FROM orders""",
    "parse_cells": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') || ' 12:00'
        WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00' END AS parsed FROM orders""",
    "excel_serial": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS back FROM orders",
    "first_link": """WITH found AS (SELECT page_id, url, nullif(regexp_extract(html, '(?i)href="([^"]+)"', 1), '') AS href FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
                             WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
                             WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
                             ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || href END AS link FROM found""",
    "latest_edition": """WITH days AS (SELECT ts::DATE AS day, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY 1),
        probes AS (SELECT date_trunc('month', day)::DATE AS edition, day(day) % 2 AS prefix_order, 'https://example.org/' || day AS url, ok FROM days)
        SELECT arg_min(url, (back, prefix_order, url)) AS url, min(back)::INTEGER AS back FROM (
          SELECT p.*, date_diff('month', edition, DATE '2024-03-01') AS back FROM probes p WHERE ok) WHERE back BETWEEN 0 AND 11""",
    "feed_union": f"""{_BASE} SELECT 'https://example.org/' || lower(r_name) AS url, 'monthly' AS change_frequency, 0.5::DOUBLE AS priority, NULL AS last_modified FROM region
        UNION ALL SELECT 'https://example.org/project/' || slug, 'weekly', 0.7, strftime(created_at, '%Y-%m-%d') FROM dto""",
    "csv_projection": f"""{_WITH_STATE} SELECT name, project_type, fuel_type, coalesce(state, '') AS state, '' AS county, coalesce(floor(capacity_value)::BIGINT::VARCHAR, '') AS capacity_value, capacity_unit,
        coalesce(days::VARCHAR, '') AS days_waiting, current_stage, 'interconnection_queue_backlog' AS cause_slugs, 'verified' AS verification_status, 'EIA-860M' AS data_source
        FROM dto LEFT JOIN listed ON l_orderkey = id""",
    "policy_with_cause": """WITH counts AS (SELECT (o_orderkey % 7)::INTEGER AS n, count(*) AS projects FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
        named(n, slug, label, title) AS (VALUES (0, 'interconnection_queue_backlog', 'Interconnection queue backlog', 'Interconnection process reform'),
          (1, 'environmental_review_nepa', 'Environmental review timeline (NEPA)', 'NEPA timeline & review reform'), (2, 'multi_agency_permitting', 'Multi-agency permitting', 'One Federal Decision'),
          (3, 'transmission_siting_land_rights', 'Transmission siting & land rights', 'Federal backstop transmission siting'), (4, 'litigation_legal_challenge', 'Litigation / legal challenge', 'Judicial review reform'),
          (5, 'local_state_opposition', 'Local/state opposition', 'Earlier community engagement'))
        SELECT slug, title, label, projects FROM counts JOIN named USING (n)""",
    "encode_url": "SELECT p_partkey, url_encode(p_name || ' + ' || p_type) AS query FROM part",
    "merge_by_match_key": """SELECT 'm' || (c_custkey % 100) AS match_key, min(c_custkey) AS id, arg_min(c_name, c_custkey) FILTER (c_custkey % 3 = 0) AS name FROM customer GROUP BY 1""",
    "error_rows": f"""{_BASE} SELECT CASE WHEN capacity_value IS NULL THEN 'no capacity' ELSE 'no filing' END AS message, count(*) AS n FROM dto WHERE capacity_value IS NULL OR filed IS NULL GROUP BY 1""",
    "normalize_all": f"""{_BASE}, kept AS (
          SELECT *, id || '-' || CASE WHEN id % 6 <> 0 THEN 'G1' ELSE '' END AS source_id, name || ' (Unit ' || CASE WHEN id % 6 <> 0 THEN 'G1' ELSE '?' END || ')' AS full_name
          FROM dto WHERE NOT (coalesce(round(capacity_value, 5) < 250, false)) AND id % 8 <> 0)
        SELECT source_id, 'eia:' || source_id AS match_key, {_slug("full_name", "('eia:' || source_id)")} AS slug, full_name AS name, project_type, fuel_type, round(capacity_value, 5) AS capacity_value,
               current_stage, CASE WHEN id % 2 = 0 THEN '6/2030.' ELSE '2030.' END AS planned FROM kept""",
    "serialize_projects": f"""{_BASE}, causes AS (SELECT l_orderkey, string_agg(DISTINCT 'flag_' || l_returnflag, '|' ORDER BY 'flag_' || l_returnflag) AS causes FROM lineitem GROUP BY 1),
        links AS (SELECT l_orderkey, string_agg(url, ',' ORDER BY l_linenumber) AS sources, arg_min(k, l_linenumber) AS k FROM (
          SELECT l_orderkey, l_linenumber, min(l_partkey::VARCHAR) AS url, any_value(l_orderkey % 3) AS k FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL) GROUP BY 1),
        stones AS (SELECT l_orderkey, string_agg(strftime(l_shipdate, '%Y%m%d') || ':' || l_linestatus || ':' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, ','
          ORDER BY l_shipdate, l_linestatus, l_partkey || '-' || l_suppkey || '-' || l_linenumber) AS milestones FROM lineitem GROUP BY 1)
        SELECT id, coalesce(causes, '') AS causes, coalesce(sources, '') AS sources, CASE k WHEN 0 THEN 'lbnl' WHEN 1 THEN 'ornlHydro' ELSE 'other' END AS source_key, coalesce(milestones, '') AS milestones, days AS days_waiting
        FROM dto LEFT JOIN causes c ON c.l_orderkey = id LEFT JOIN links l ON l.l_orderkey = id LEFT JOIN stones s ON s.l_orderkey = id""",
    "get_project": f"{_BASE} SELECT id, slug, name, current_stage FROM dto ORDER BY slug LIMIT 1",
    "ingest_sheet": f"""{_BASE} SELECT 'P-' || id AS source_id, 'Dam "' || name || '", phase 1 (FERC No. P-' || id || ')' AS name, round(capacity_value, 5) AS capacity_value,
        coalesce(CASE WHEN id % 2 = 0 THEN strftime(filed, '%Y-%m-%d') END, CASE WHEN id % 3 = 0 THEN '2019-02-15' END) AS filed, 'agency_permitting' AS current_stage,
        'FERC relicensing: Pending Relicense' || CASE WHEN id % 5 = 0 THEN ' (ILP process)' ELSE '' END AS current_status, (id % 2 <> 0 OR filed IS NULL) AND id % 3 = 0 AS noted
        FROM dto WHERE id % 4 <> 0 AND NOT coalesce(capacity_value < 250, false)""",
    "ingest_dashboard": f"""{_BASE}, landed AS (SELECT id, ['LNG terminal', 'Solar and storage', 'Upwind ranch', 'Amsterdam works', 'plain'][1 + id % 5] AS title,
          ['Electricity Transmission', 'Energy Storage', 'Pipelines', 'Conventional Energy Production', 'Renewable Energy Production', 'Ports'][1 + id % 6] AS sector,
          ['Complete', 'Withdrawn', 'Under Construction', 'Paused'][1 + id % 4] AS status FROM dto)
        SELECT id::VARCHAR AS source_id, title AS name, CASE id % 6 WHEN 0 THEN 'transmission' WHEN 1 THEN 'storage' WHEN 2 THEN 'pipeline' ELSE 'generation' END AS project_type,
        CASE id % 5 WHEN 0 THEN 'lng' WHEN 1 THEN 'solar' WHEN 3 THEN 'hydro' ELSE CASE id % 6 WHEN 0 THEN 'transmission' WHEN 1 THEN 'storage' WHEN 2 THEN 'pipeline' ELSE 'other' END END AS fuel_type,
        status || CASE WHEN id % 7 = 0 THEN ' (lead: BLM)' ELSE '' END AS current_status, CASE id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'under_construction' ELSE 'agency_permitting' END AS current_stage,
        CASE WHEN id % 2 = 0 THEN 'http://x' ELSE 'https://www.permits.performance.gov/permitting-project/' || id END AS url FROM landed WHERE sector <> 'Ports'""",
    "ingest_summary": f"""{_BASE} SELECT count(*) FILTER (kept AND filed IS NOT NULL AND current_stage <> 'under_construction') AS upserted,
        count(*) FILTER (kept AND filed IS NOT NULL AND current_stage = 'under_construction') AS removed_resolved,
        count(*) FILTER (NOT kept) AS skipped_below_floor, 0::BIGINT AS skipped_not_waiting, 0::BIGINT AS skipped_not_active, 0::BIGINT AS skipped_already_cleared,
        count(*) FILTER (kept AND filed IS NULL) AS errors FROM (SELECT *, NOT coalesce(capacity_value < 250, false) AS kept FROM dto)""",
    "incremental_ingest": f"""WITH {_proj()}, {_proj(True, "shifted")},
        base AS (SELECT *, CASE WHEN id % 2 = 0 THEN '2001-01-01' ELSE '2001-01-02' END AS day FROM proj WHERE current_stage <> 'under_construction'),
        change AS (SELECT * FROM shifted WHERE id % 5 = 0)
        SELECT coalesce(c.slug, b.slug) AS slug, coalesce(c.current_stage, b.current_stage) AS current_stage,
               round(CASE WHEN c.slug IS NULL THEN b.capacity_value ELSE c.capacity_value END, 6) AS capacity_value,
               coalesce(b.day, '2001-01-03') AS created_at, CASE WHEN c.slug IS NULL THEN b.day ELSE '2001-01-03' END AS updated_at
        FROM base b FULL JOIN change c ON b.slug = c.slug WHERE c.slug IS NULL OR c.current_stage <> 'under_construction'""",
    "format_usd_capacity": f"""{_BASE}, sized AS (
          SELECT *, CASE WHEN id % 2 = 0 THEN floor(capacity_value) / CASE WHEN id % 4 = 0 THEN 8 ELSE 1 END ELSE floor(capacity_value) * 10 + 1 END AS c FROM dto),
        priced AS (SELECT *, CASE WHEN capacity_unit = 'MW' THEN c * 1000 * cost END * [1.0000123, 1.0000123e-3, 1.0000123e-6, 1.0000123e3][1 + id % 4]::DOUBLE AS x FROM sized)
        SELECT id, CASE WHEN x >= 1e9 THEN printf('$%.2fB', x / 1e9) WHEN x >= 1e6 THEN printf('$%.1fM', x / 1e6) WHEN x >= 1e3 THEN printf('$%.0fK', x / 1e3) WHEN x IS NOT NULL THEN printf('$%.0f', x) END AS usd,
          CASE WHEN c IS NULL THEN 'Not disclosed' ELSE trim(CASE WHEN c >= 100 THEN format('{{:,}}', floor(c + 0.5)::BIGINT) WHEN c = floor(c) THEN c::BIGINT::VARCHAR ELSE c::VARCHAR END
            || ' ' || CASE WHEN id % 13 <> 0 THEN capacity_unit ELSE '' END) END AS capacity,
          CASE WHEN days IS NULL THEN '—' ELSE printf('%.1f yrs', days / 365.25) END AS waiting,
          name || CASE WHEN days IS NULL THEN ' is waiting for approval.' ELSE printf(' has been waiting %.1f years for approval.', days / 365.25) END AS share FROM priced""",
    "detail_view": f"""{_WITH_STATE}, shown AS (
          SELECT dto.*, CASE WHEN id % 3 = 0 THEN 'County ' || id % 10 END AS place, listed.state AS states, floor(dto.capacity_value) AS c, CASE WHEN id % 19 = 0 THEN 'on_the_way' ELSE dto.current_stage END AS stage
          FROM dto LEFT JOIN listed ON l_orderkey = id)
        SELECT slug, concat_ws(', ', place, states) AS location, {_map_cases("stage", D.STAGES, "on the way")} AS stage_label,
          CASE WHEN c IS NULL THEN 'Not disclosed' WHEN c >= 100 THEN format('{{:,}}', c::BIGINT) || ' ' || capacity_unit ELSE c::BIGINT || ' ' || capacity_unit END AS capacity,
          CASE WHEN days IS NULL THEN '—' ELSE printf('%.1f yrs', days / 365.25) END AS waiting, CASE WHEN applicable THEN '$' || format('{{:,}}', cost::BIGINT) || '/kW' END AS cost,
          CASE WHEN id % 4 <> 0 AND id % 6 <> 0 THEN printf('%.4f, %.4f', 30 + (id % 1000) / 1000 + 0.00001, -90 - (id % 700) / 1000 - 0.00001) END AS coordinates FROM shown""",
    "ingest_eia": f"""{_BASE}, landed AS (
          SELECT *, round(capacity_value, 5) AS c, id || '-' || CASE WHEN id % 6 <> 0 THEN 'G1' ELSE '' END AS source_id,
            'Plant "A", ' || name || ' (Unit ' || CASE WHEN id % 6 <> 0 THEN 'G1' ELSE '?' END || ')' AS full_name,
            CASE id % 4 WHEN 2 THEN 'wind_offshore' WHEN 3 THEN 'storage' ELSE fuel_type END AS fuel FROM dto),
        kept AS (SELECT *, CASE WHEN id % 10 = 0 THEN 'site:' || id ELSE 'eia:' || source_id END AS match_key FROM landed WHERE NOT coalesce(c < 250, false) AND id % 8 <> 0)
        SELECT source_id, match_key, {_slug("full_name", "match_key")} AS slug, full_name AS name, CASE WHEN fuel = 'storage' THEN 'storage' ELSE 'generation' END AS project_type, fuel AS fuel_type,
          CASE WHEN id % 2 = 0 THEN 31.5::DOUBLE END AS lat, CASE WHEN id % 2 = 0 THEN -99.25::DOUBLE END AS lon, 'TX' AS state, c AS capacity_value, current_stage,
          CASE WHEN id % 2 = 0 THEN '6/2030.' ELSE '2030.' END AS planned FROM kept""",
    "ingest_lbnl": f"""{_BASE}, landed AS (
          SELECT *, ['Active', 'active', 'withdrawn', 'ACTIVE'][1 + id % 4] AS q_status, 'Grid ' || id % 4 AS entity, 'Q' || id AS q_id,
            ['Solar+Battery', 'Offshore Wind', 'Upwind', 'Gas', 'Coal', ''][1 + id % 6] AS kind, ['Facility Study', 'IA Executed', '', 'Construction', 'System Impact Study'][1 + id % 5] AS phase,
            ['West', '', 'Northeast'][1 + id % 3] AS region, CASE WHEN id % 5 <> 0 THEN id % 30 END AS n FROM dto),
        kept AS (
          SELECT *, entity || '-' || q_id AS source_id, entity || ' Interconnection Request ' || q_id || CASE WHEN kind <> '' THEN ' (' || kind || ')' ELSE '' END AS full_name,
            ['solar', 'wind_offshore', 'other', 'gas', 'other', 'other'][1 + id % 6] AS fuel
          FROM landed WHERE q_status <> 'withdrawn' AND phase NOT IN ('IA Executed', 'Construction') AND NOT coalesce(round(capacity_value, 5) < 250, false))
        SELECT source_id, 'lbnl:' || source_id AS match_key, {_slug("full_name", "('lbnl:' || source_id)")} AS slug, full_name AS name, 'generation' AS project_type, fuel AS fuel_type,
          n_nationkey + 0.5::DOUBLE AS lat, -n_nationkey - 0.25::DOUBLE AS lon, CASE WHEN id % 2 = 0 THEN 'Kings' END AS county, round(capacity_value, 5) AS capacity_value,
          'Interconnection queue status: active' || CASE WHEN phase <> '' THEN ' (' || phase || ')' ELSE '' END || CASE WHEN region <> '' THEN ', ' || region || ' region' ELSE '' END AS current_status,
          'interconnection_study' AS current_stage, 'interconnection_queue_backlog' AS causes, CASE WHEN id % 3 <> 2 THEN strftime(filed, '%Y-%m-%d') END AS filed, n_nationkey IS NULL AS unplaced
        FROM kept LEFT JOIN nation ON n_nationkey = n AND n_nationkey % 4 <> 0""",
    "ingest_pipelines": f"""{_PIPELINES}
        SELECT source_id, 'eiaPipelines:' || source_id AS match_key, {_slug("full_name", "('eiaPipelines:' || source_id)")} AS slug, full_name AS name, 'pipeline' AS project_type, 'pipeline' AS fuel_type,
          ['NY,CT,MA,RI', 'TX, MX', 'TX'][1 + id % 3] AS state, c AS capacity_value, 'MMcf/d' AS capacity_unit,
          'EIA pipeline tracker: ' || trim(landed_status) || CASE WHEN id % 3 = 0 THEN ' (Interstate pipeline)' ELSE '' END AS current_status, stage AS current_stage,
          'No filing date is published, only a year in service (' || CASE WHEN id % 5 <> 0 THEN '2031' ELSE 'unknown' END || ').' || CASE WHEN id % 3 = 0 THEN ' Project length: ' || id % 100 || ' miles.' ELSE '' END
            || CASE WHEN id % 2 = 0 THEN ' Estimated cost: $' || id % 1000 || ' million.' ELSE '' END AS note FROM kept""",
    "ingest_counts": f"""{_PIPELINES}, slugs AS (SELECT slug, arg_max(stage, id) AS stage FROM (SELECT {_slug("full_name", "('eiaPipelines:' || source_id)")} AS slug, stage, id FROM kept) GROUP BY slug),
        resolved AS (SELECT *, stage IN ('approved_awaiting_construction', 'under_construction', 'cancelled', 'completed') AS gone FROM kept)
        SELECT count(*) FILTER (NOT gone) AS upserted, count(*) FILTER (gone) AS removed_resolved, 0::BIGINT AS skipped_below_floor, (SELECT count(*) FROM dto) - count(*) AS skipped_not_waiting,
          0::BIGINT AS skipped_not_active, 0::BIGINT AS skipped_already_cleared, 0::BIGINT AS errors, (SELECT count(*) FILTER (stage NOT IN ('approved_awaiting_construction', 'under_construction', 'cancelled', 'completed')) FROM slugs) AS stored,
          (SELECT count(*) FILTER (stage NOT IN ('approved_awaiting_construction', 'under_construction', 'cancelled', 'completed')) FROM slugs) AS updated FROM resolved""",
    "overrides_file": """SELECT s_suppkey::VARCHAR AS source_id, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 3 <> 2 AND s_suppkey % 20 <> 0 THEN 'merged-' || s_suppkey ELSE 'supplier:' || s_suppkey END AS match_key FROM supplier""",
    "exclude_containing": "SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT contains(lower(o_orderpriority), 'urgent') AND NOT contains(lower(o_orderpriority), 'low')",
    "source_in": f"""{_BASE}, keyed AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'other' ELSE ['eia', 'lbnl', 'other', 'ornlHydro', 'permittingDashboard'][1 + id % 5] END AS source_key FROM dto)
        SELECT id, source_key FROM keyed WHERE source_key IN ('lbnl', 'permittingDashboard', 'other')""",
    "default_order": f"{_BASE} SELECT id, name FROM dto ORDER BY created_at, id LIMIT 40 OFFSET 10",
    "sort_orders": f"""{_BASE}, rows AS (
          SELECT *, CASE WHEN id % 4 <> 0 THEN 'S' || id % 50 ELSE '' END AS state, {_map_cases("fuel_type", D.FUEL_TYPES, "")} AS fuel_label, {_map_cases("current_stage", D.STAGES, "")} AS stage_label FROM dto)
        """ + " UNION ALL ".join(
            f"(SELECT '{key}' AS key, {down == 'DESC'} AS descending, id FROM rows ORDER BY {col} {down}, created_at, id LIMIT 12 OFFSET 5)"
            for key, col in (("name", "name"), ("fuel", "fuel_label"), ("state", "state"), ("daysWaiting", "coalesce(days, -1)"), ("capacity", "coalesce(capacity_value, -1)"), ("stage", "stage_label")) for down in ("ASC", "DESC")
        ),
    "json_export": f"""{_BASE}, shown AS (SELECT *, strftime(filed, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM dto)
        SELECT id, '{{"slug":"' || slug || '","name":"' || name || '","application_filed_date":' || coalesce('"' || iso || '"', 'null') || ',"county":null,"is_aggregate_example":' || is_aggregate::VARCHAR
          || ',"cause_slugs":["interconnection_queue_backlog"],"days_waiting":' || coalesce(days::BIGINT::VARCHAR, 'null') || ',"milestones":['
          || CASE WHEN id % 3 = 0 THEN '{{"date":' || coalesce('"' || iso || '"', 'null') || ',"stage":"' || current_stage || '","description":"said \\"so\\""}}' ELSE '' END || ']}}' AS json,
          round(capacity_value, 6) AS capacity_value, applicable, CASE WHEN applicable THEN cost::DOUBLE END AS cost_per_kw FROM shown""",
}
ORACLES["csv_export"] = ORACLES["csv_projection"].replace("SELECT name, project_type", "SELECT 'the \"' || name || '\", so called' AS name, project_type")

# ---- what runs maintain
ORACLES["upsert_buckets"] = ORACLES["upsert_snapshot"]
_STORED = f"""{_RUNS}, stored AS (
  SELECT coalesce(s.slug, f.slug) AS slug, coalesce(s.id, f.id) AS id, coalesce(s.fuel_type, f.fuel_type) AS fuel_type, coalesce(s.project_type, f.project_type) AS project_type,
         coalesce(s.current_stage, f.current_stage) AS current_stage, CASE WHEN s.slug IS NULL THEN f.capacity_value ELSE s.capacity_value END AS capacity_value,
         coalesce(s.capacity_unit, f.capacity_unit) AS capacity_unit, coalesce(s.is_aggregate, f.is_aggregate) AS is_aggregate
  FROM first f FULL JOIN second s ON f.slug = s.slug WHERE s.slug IS NULL OR s.current_stage <> 'under_construction'
), dto AS (
  SELECT *, {_COST} AS cost, capacity_unit = 'MW' AND {_COST} IS NOT NULL AND capacity_value IS NOT NULL AS applicable FROM stored
)"""
# sums of decimals, as the kept ones are; the largest in whole dollars
_EXACT_STATS = f"""
SELECT count(*) AS total_projects,
       round(coalesce(sum(mw), 0)::DOUBLE, 2) AS total_capacity_mw, round(coalesce(sum((capacity_value * 1000 * cost)::DECIMAL(38, 6)) FILTER (applicable), 0)::DOUBLE, 0) AS total_investment,
       count(*) FILTER (applicable) AS investment_count, round(coalesce(sum(mw) FILTER ({_CLEAN}), 0)::DOUBLE, 2) AS clean_mw, count(mw) FILTER ({_CLEAN}) AS clean_count
FROM (SELECT *, CASE WHEN capacity_unit = 'MW' THEN capacity_value::DECIMAL(38, 6) END AS mw FROM dto)
"""
ORACLES |= {
    "bucket_children": f"""{_STORED} SELECT child, current_stage AS stage, count(*) AS n, count(DISTINCT slug) AS projects
        FROM dto JOIN (SELECT unnest(['milestones', 'project_causes', 'project_sources']) AS child) ON child <> 'milestones' OR id % 3 = 0 GROUP BY child, current_stage""",
    "past_version": f"""{_RUNS} SELECT sha256(slug) AS id, slug, round(capacity_value, 6) AS capacity_value, current_stage, 'verified' AS verification_status,
        '2001-01-01' AS created_at, '2001-01-01' AS updated_at FROM first""",
    "change_feed": f"""{_RUNS} SELECT s.slug, CASE WHEN f.slug IS NULL THEN 'insert' WHEN s.current_stage = 'under_construction' THEN 'delete' ELSE 'update' END AS change,
        f.current_stage AS old_stage, nullif(s.current_stage, 'under_construction') AS new_stage
        FROM second s LEFT JOIN first f ON f.slug = s.slug WHERE f.slug IS NOT NULL OR s.current_stage <> 'under_construction'""",
    "delta_stats": f"{_STORED} {_EXACT_STATS} WHERE NOT is_aggregate",
    "delta_filtered_stats": f"""{_STORED} {_EXACT_STATS} WHERE NOT is_aggregate AND fuel_type IN ('solar', 'nuclear', 'gas')
        AND current_stage IN ('planned_pre_filing', 'regulatory_approvals_pending') AND project_type = 'generation'""",
    "state_index": f"""{_STORED} SELECT sha256(slug) AS id, slug, 'S' || id % 50 || ', S' || id % 7 || ',' AS state FROM dto WHERE id % 9 <> 0 AND (id % 50 = 5 OR id % 7 = 5)""",
}
ORACLES["stateful_ingest"] = f"""WITH {_proj()}, {_proj(True, "shifted")},
  base AS (SELECT * FROM proj WHERE current_stage <> 'under_construction'), change AS (SELECT * FROM shifted WHERE id % 5 = 0)
SELECT coalesce(c.slug, b.slug) AS slug, coalesce(c.current_stage, b.current_stage) AS current_stage, round(CASE WHEN c.slug IS NULL THEN b.capacity_value ELSE c.capacity_value END, 6) AS capacity_value,
       CASE WHEN b.slug IS NULL THEN '2001-01-02' ELSE '2001-01-01' END AS created_at, CASE WHEN c.slug IS NULL THEN '2001-01-01' ELSE '2001-01-02' END AS updated_at, 2::BIGINT AS versions
FROM base b FULL JOIN change c ON b.slug = c.slug WHERE c.slug IS NULL OR c.current_stage <> 'under_construction'"""
ORACLES |= {
    "seek_pages": f"""{_BASE}, rows AS (
          SELECT *, CASE WHEN id % 4 <> 0 THEN 'S' || id % 50 ELSE '' END AS state, {_map_cases("fuel_type", D.FUEL_TYPES, "")} AS fuel_label, {_map_cases("current_stage", D.STAGES, "")} AS stage_label FROM dto)
        """ + " UNION ALL ".join(
            f"(SELECT '{key}' AS key, {down == 'DESC'} AS descending, ((row_number() OVER (ORDER BY {col} {down}, created_at, id) - 1) // 8 + 1)::INTEGER AS page, id FROM rows ORDER BY {col} {down}, created_at, id LIMIT 24)"
            for key, col in (("name", "name"), ("fuel", "fuel_label"), ("state", "state"), ("daysWaiting", "coalesce(days, -1)"), ("capacity", "coalesce(capacity_value, -1)"), ("stage", "stage_label")) for down in ("ASC", "DESC")
        ),
    "sheet_source": f"""{_BASE} SELECT 'P-' || id AS source_id, 'Dam "A",' || chr(10) || name || ' (FERC No. P-' || id || ')' AS name, round(capacity_value, 5) AS capacity_value, strftime(filed, '%Y-%m-%d') AS filed,
        (SELECT count(*) FILTER (id % 41 = id % 2) FROM dto) AS errors, (SELECT count(*) FILTER (round(capacity_value, 5) < 250) FROM dto) AS below_floor FROM dto WHERE NOT coalesce(round(capacity_value, 5) < 250, false)""",
    "quarantine": f"""{_BASE}, landed AS (SELECT *, id % 17 = 0 AS cut, id % 13 = 0 AS unnamed, id % 4 = 0 AS gone FROM dto)
        SELECT count(*) FILTER (NOT cut AND NOT unnamed AND NOT gone) AS upserted, count(*) FILTER (NOT cut AND NOT unnamed AND gone) AS removed_resolved, 0::BIGINT AS skipped_below_floor, 0::BIGINT AS skipped_not_waiting,
          0::BIGINT AS skipped_not_active, 0::BIGINT AS skipped_already_cleared, count(*) FILTER (cut OR unnamed) AS errors, count(*) FILTER (cut) AS unread, count(*) FILTER (cut) AS with_text FROM landed""",
    "sector_scan": f"{_BASE} SELECT id::VARCHAR AS project_id, name AS project_title, CASE id % 6 WHEN 5 THEN 'Ports' ELSE 'Pipelines' END AS project_sector FROM dto WHERE id % 6 IN (2, 5)",
}
