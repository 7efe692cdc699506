"""SQL counterparts of the registered queries."""

from __future__ import annotations

from billrate.sources.trade_tables import ZH_FEATURES, ZH_WORDS
from suite import sqltext as X
from suite.inputs import LINK_BASE

MONEY = "DECIMAL(18,2)"
NONE = f"CAST(NULL AS {MONEY})"


def recode(c, words):
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items())
    return f"CASE {c} {whens} ELSE '' END"


def zh_name(c):
    first, last = f"split_part({c}, ' ', 1)", f"split_part({c}, ' ', -1)"
    return f"({recode(first, ZH_WORDS)} || {recode(last, ZH_WORDS)})"


def quotas(zh=False):
    price = f"CAST(p_retailprice AS {MONEY})"
    name = zh_name("p_name") if zh else "p_name"
    feature = recode("p_type", ZH_FEATURES) if zh else "p_type"
    return (
        f"quotas AS (SELECT p_partkey AS id, 'Q' || p_partkey AS quota_code, {name} AS quota_name, "
        f"{feature} AS feature_value, 'EA' AS unit, {price} AS unit_price, "
        f"CAST({price} * 0.30 AS {MONEY}) AS labor_cost, CAST({price} * 0.60 AS {MONEY}) AS "
        f"material_cost, {NONE} AS machine_cost, CAST(NULL AS VARCHAR) AS remark, "
        "CAST(substring(p_brand, 7) AS BIGINT) AS version_id FROM part)"
    )


LINES = (
    f"lines AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS id, "
    f"min(l_partkey) AS part, min(l_suppkey) AS user_id, sum(CAST(l_quantity AS {MONEY})) AS "
    "quantity, min(l_returnflag) AS flag, CAST(min(l_tax) AS DECIMAL(4,2)) AS tax, "
    "CAST(min(l_discount) AS DECIMAL(4,2)) AS discount FROM lineitem "
    "GROUP BY l_orderkey, l_linenumber)"
)


def items(zh=False):
    name = zh_name("p_name") if zh else "p_name"
    noun = "split_part(p_name, ' ', -1)"
    noun = recode(noun, ZH_WORDS) if zh else noun
    suffix = "（含支架）" if zh else " (x)"
    feature = recode("p_type", ZH_FEATURES) if zh else "p_type"
    return (
        f"{LINES}, items AS (SELECT l.id, l.user_id, 'I' || l_orderkey AS item_code, "
        f"CASE flag WHEN 'N' THEN {name} || '{suffix}' WHEN 'R' THEN {noun} || ' ' || {name} "
        f"ELSE {name} END AS item_name, {feature} AS feature_value, "
        "CASE WHEN tax = 0.08 THEN NULL WHEN tax = 0.07 THEN ' ' ELSE 'EA' END AS unit, "
        f"CAST(quantity AS {MONEY}) AS quantity, "
        "CASE WHEN discount = 0.10 THEN 2 WHEN discount = 0.09 THEN 3 "
        "WHEN discount = 0.08 THEN NULL ELSE 0 END AS match_status "
        "FROM lines l JOIN part ON part = p_partkey)"
    )


def base():
    """Quotas, items and the settled bill."""
    held = "(discount <> 0.08 AND NOT (discount = 0.09 AND tax < 0.04))"
    return (
        f"{quotas()}, {items()}, settled AS (SELECT i.id, i.user_id, i.item_code, i.item_name, "
        "i.feature_value, i.unit, i.quantity, "
        f"CASE WHEN {held} THEN l.part END AS matched_quota_id, "
        f"CASE WHEN {held} THEN q.quota_code END AS matched_quota_code, "
        f"CASE WHEN {held} THEN q.quota_name END AS matched_quota_name, "
        f"CASE WHEN {held} THEN q.feature_value END AS matched_quota_feature_value, "
        f"CASE WHEN {held} THEN q.unit_price END AS matched_unit_price, "
        f"CASE WHEN {held} THEN CAST(i.quantity * q.unit_price AS {MONEY}) END AS total_price, "
        "CASE WHEN discount = 0.10 THEN 2 WHEN discount = 0.09 THEN 3 WHEN discount = 0.08 THEN "
        "NULL WHEN discount >= 0.06 THEN 0 ELSE 1 END AS match_status, "
        "CAST(NULL AS VARCHAR) AS remark "
        "FROM items i JOIN lines l USING (id) JOIN quotas q ON q.id = l.part)"
    )


LINKS = (
    "links AS (SELECT m.id * " + str(LINK_BASE) + " + p.l_partkey AS id, m.id AS project_item_id, "
    "p.l_partkey AS quota_id, q.quota_code, q.quota_name, q.feature_value AS quota_feature_value, "
    "q.unit_price, p.sort_order FROM lines m JOIN (SELECT l_orderkey, l_partkey, "
    "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS INTEGER) AS "
    "sort_order FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) p "
    "ON p.l_orderkey = m.l_orderkey JOIN quotas q ON q.id = p.l_partkey WHERE m.discount = 0.09)"
)
EDITS = (
    "edits AS (SELECT (o_orderkey // 2) * 20 + 1 + o_custkey % 7 AS item_id, o_custkey AS quota_id, "
    f"o_orderkey AS edit_seq, CAST(o_totalprice AS {MONEY}) AS price, o_orderstatus, "
    "o_orderpriority FROM orders)"
)
VERSIONS = (
    "versions AS (SELECT CAST(substring(p_brand, 7) AS BIGINT) AS id, p_brand AS version_name, "
    "CAST(NULL AS VARCHAR) AS description FROM part GROUP BY p_brand)"
)
VIEW = (
    "id, matched_quota_id, matched_quota_code, matched_quota_name, matched_quota_feature_value, "
    "matched_unit_price, total_price, match_status"
)


def full():
    return f"WITH {base()}, {LINKS}, {EDITS}"


OPEN = "coalesce(match_status, 0) NOT IN (2, 3)"
ELIGIBLE = f"{OPEN} AND NOT {X.blank('unit')}"


def texts():
    n, f = X.jtrim("coalesce({}, '')"), X.jtrim("coalesce(feature_value, '')")
    return (
        f"it AS (SELECT DISTINCT {n.format('item_name')} AS n, {f} AS f FROM items "
        f"WHERE {ELIGIBLE}), qt AS (SELECT {n.format('quota_name')} AS n, {f} AS f, "
        "min(id) AS qid FROM quotas GROUP BY 1, 2)"
    )


def match(zh, early=True, before="", weighted=None, catalogue=None):
    good = "s >= 0.8" if early else "false"
    n, f = X.jtrim("i.item_name"), X.jtrim("i.feature_value")
    return (
        f"WITH {catalogue or quotas(zh)}, {items(zh)}, {before}{texts()}, "
        f"{X.scored_ctes('it', 'qt', weighted)}, best AS (SELECT * FROM scored "
        f"QUALIFY row_number() OVER (PARTITION BY n, f ORDER BY CASE WHEN {good} THEN 0 ELSE 1 END, "
        f"CASE WHEN {good} THEN 0 ELSE -s END, qid) = 1) "
        "SELECT i.id, q.id AS matched_quota_id, q.quota_code AS matched_quota_code, "
        "q.quota_name AS matched_quota_name, q.feature_value AS matched_quota_feature_value, "
        f"q.unit_price AS matched_unit_price, CAST(i.quantity * q.unit_price AS {MONEY}) AS "
        "total_price, CAST(CASE WHEN q.id IS NOT NULL THEN 1 WHEN coalesce(i.match_status, 0) IN "
        "(2, 3) THEN i.match_status ELSE 0 END AS INTEGER) AS match_status, "
        f"round(b.s, 9) AS score FROM items i LEFT JOIN best b ON b.s >= 0.3 AND b.n = {n} AND "
        f"b.f = {f} AND {ELIGIBLE.replace('match_status', 'i.match_status').replace('unit', 'i.unit')} "
        "LEFT JOIN quotas q ON q.id = b.qid"
    )


PAIRS = (
    f"WITH {quotas(True)}, {items(True)}, pairs AS (SELECT DISTINCT i.item_name, i.feature_value, "
    "q.quota_name, q.feature_value AS quota_feature FROM items i JOIN quotas q ON q.id = i.user_id)"
)
NAMES = f"{PAIRS}, names AS (SELECT DISTINCT item_name, quota_name FROM pairs)"
NAME_LISTS = (
    f"{NAMES}, lists AS MATERIALIZED (SELECT item_name, quota_name, {X.keywords('item_name')} AS a, "
    f"{X.keywords('quota_name')} AS b FROM names)"
)
RECORDS = (
    "pairs AS (SELECT item_name, feature_value AS item_feature_value, matched_quota_id AS quota_id, "
    "match_status AS match_type FROM settled WHERE match_status > 0 AND matched_quota_id IS NOT NULL "
    "UNION ALL SELECT s.item_name, s.feature_value, l.quota_id, 3 FROM settled s JOIN links l ON "
    "l.project_item_id = s.id WHERE s.match_status = 3 AND s.matched_quota_id IS NULL), "
    "paired AS (SELECT p.item_name, p.item_feature_value, p.match_type, q.quota_name, "
    "q.feature_value AS quota_feature_value, CAST(0.5 AS DOUBLE) AS match_score "
    "FROM pairs p JOIN quotas q ON q.id = p.quota_id), "
    "words AS MATERIALIZED (SELECT t, "
    f"{X.ordered(X.keywords('t'))} AS k FROM (SELECT item_name AS t FROM paired UNION SELECT "
    "item_feature_value FROM paired UNION SELECT quota_name FROM paired UNION SELECT "
    "quota_feature_value FROM paired)), "
    "records0 AS (SELECT p.*, list_concat(a.k, b.k) AS item_keywords, list_concat(c.k, d.k) AS "
    "quota_keywords, CASE WHEN match_type IN (2, 3) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS "
    "learning_weight FROM paired p JOIN words a ON a.t = item_name JOIN words b ON b.t = "
    "item_feature_value JOIN words c ON c.t = quota_name JOIN words d ON d.t = quota_feature_value), "
    "records AS (SELECT *, "
    + X.ordered("list_distinct(list_filter(item_keywords, lambda x: list_contains(quota_keywords, x)))")
    + " AS common_keywords FROM records0)"
)
WEIGHTS = (
    "counts AS (SELECT keyword, CAST(sum(floor(learning_weight)) AS INTEGER) AS match_count, "
    "CAST(count(*) AS INTEGER) AS total_count FROM (SELECT unnest(common_keywords) AS keyword, "
    "learning_weight FROM records) GROUP BY keyword), weights AS (SELECT keyword, match_count, "
    "total_count, match_count / total_count::DOUBLE AS success_rate, greatest(0.5::DOUBLE, "
    "least(2.0::DOUBLE, 1.0::DOUBLE + (match_count / total_count::DOUBLE - 0.5::DOUBLE) * "
    "2.0::DOUBLE)) AS weight FROM counts)"
)
KEY = "coalesce(quota_name, 'null') || '|' || coalesce(quota_feature_value, 'null')"
RULES = (
    f"manual AS (SELECT {KEY} AS g, item_name, item_keywords FROM records WHERE match_type = 2), "
    "sizes AS (SELECT g, count(*) AS n FROM manual GROUP BY g), named AS (SELECT g, keyword, "
    "list_sort(list(DISTINCT item_name)) AS names FROM (SELECT g, item_name, "
    "unnest(item_keywords) AS keyword FROM manual) GROUP BY g, keyword), "
    "rules AS (SELECT keyword, names, 0.7::DOUBLE + (len(names) / n::DOUBLE) * 0.3::DOUBLE AS "
    "confidence FROM named JOIN sizes USING (g) WHERE n >= 2 AND len(names) >= 2 AND "
    "len(names) >= n * 0.6 QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY confidence "
    "DESC, g) = 1)"
)


def learned(tail):
    return f"{full()}, {RECORDS}, {tail}"


BIG_LINKS = "big AS (SELECT l.* FROM links l JOIN part ON p_partkey = quota_id WHERE p_size > 25)"
LAST_EDIT = (
    "last AS (SELECT e.item_id, q.* FROM (SELECT e.* FROM edits e WHERE item_id IN (SELECT id FROM "
    "settled) AND quota_id IN (SELECT id FROM quotas) QUALIFY row_number() OVER (PARTITION BY "
    "item_id ORDER BY edit_seq DESC) = 1) e JOIN quotas q ON q.id = e.quota_id)"
)
FRESH = (
    "fresh AS (SELECT e.edit_seq + 1000000000000000 AS link_id, e.item_id, e.quota_id, e.edit_seq "
    "FROM edits e WHERE item_id IN (SELECT id FROM settled) AND quota_id IN (SELECT id FROM quotas) "
    "AND NOT EXISTS (SELECT 1 FROM links l WHERE l.project_item_id = e.item_id AND l.quota_id = "
    "e.quota_id) QUALIFY row_number() OVER (PARTITION BY item_id, quota_id ORDER BY edit_seq) = 1), "
    "new_links AS (SELECT link_id AS id, item_id AS project_item_id, f.quota_id, q.quota_code, "
    "q.quota_name, q.feature_value AS quota_feature_value, q.unit_price, CAST(row_number() OVER "
    "(PARTITION BY item_id ORDER BY edit_seq) - 1 + (SELECT count(*) FROM links l WHERE "
    "l.project_item_id = f.item_id) AS INTEGER) AS sort_order FROM fresh f JOIN quotas q ON "
    "q.id = f.quota_id), all_links AS (SELECT * FROM links UNION ALL BY NAME SELECT * FROM new_links)"
)


def repriced(links, touched, status="match_status"):
    """Settled items with those in ``touched`` repriced from ``links``."""
    return (
        f"sums AS (SELECT project_item_id AS item_id, CAST(coalesce(sum(unit_price), 0) AS {MONEY}) "
        f"AS p FROM {links} GROUP BY 1) SELECT id, matched_quota_id, matched_quota_code, "
        "matched_quota_name, matched_quota_feature_value, "
        f"CASE WHEN {touched} THEN p ELSE matched_unit_price END AS matched_unit_price, "
        f"CASE WHEN {touched} THEN CAST(quantity * p AS {MONEY}) ELSE total_price END AS total_price, "
        f"CASE WHEN {touched} THEN {status} ELSE match_status END AS match_status "
        "FROM settled LEFT JOIN sums ON item_id = id"
    )


SHOWN = (
    "shown AS (SELECT project_item_id, string_agg(quota_code, '; ' ORDER BY sort_order) AS codes, "
    "string_agg(quota_name, '; ' ORDER BY sort_order) AS names, string_agg((sort_order + 1) || '. ' "
    "|| quota_code || ' - ' || quota_name || ' (单价: ' || unit_price || '元)', chr(10) ORDER BY "
    "sort_order) AS detail FROM links GROUP BY 1)"
)
# Changes one after the other; ``held`` is the list of versions as it stands by then.
NATION_CHANGES = (
    f"RECURSIVE {VERSIONS}, changes AS (SELECT CASE WHEN n_regionkey < 2 THEN n_nationkey + 100 "
    "WHEN n_nationkey = 4 THEN 904 WHEN n_nationkey = 19 THEN 9 ELSE n_nationkey END AS id, "
    "CASE WHEN n_regionkey < 2 THEN 'insert' ELSE 'update' END AS op, "
    "CASE WHEN n_regionkey = 0 THEN 'Brand#' || (n_nationkey - 3) WHEN n_regionkey = 1 AND "
    "n_nationkey % 2 = 0 THEN 'Brand#' || n_nationkey WHEN n_regionkey = 3 THEN ' ' WHEN "
    "n_nationkey = 19 THEN 'moved' WHEN n_regionkey = 4 THEN 'shared' ELSE n_name END AS "
    "version_name, CASE WHEN n_regionkey <> 2 THEN n_name END AS description, "
    "CAST(n_nationkey AS BIGINT) AS edit_seq FROM nation), "
    "queue AS (SELECT *, row_number() OVER (ORDER BY edit_seq) AS k, trim(version_name) <> '' AS "
    "named FROM changes), steps AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT list({'i': CAST(id AS "
    "BIGINT), 'n': version_name}) FROM versions) AS held, false AS fine UNION ALL SELECT t.k, CASE "
    "WHEN t.fine AND t.named THEN list_append(list_filter(t.held, lambda h: h.i <> t.id), "
    "{'i': CAST(t.id AS BIGINT), 'n': t.version_name}) ELSE t.held END, t.fine FROM (SELECT q.*, "
    "s.held, CASE WHEN q.op = 'insert' THEN q.named ELSE len(list_filter(s.held, lambda h: h.i = "
    "q.id)) > 0 END AND NOT (q.named AND len(list_filter(s.held, lambda h: h.n = q.version_name AND "
    "(h.i <> q.id OR q.op = 'insert'))) > 0) AS fine FROM steps s JOIN queue q ON q.k = s.k + 1) t), "
    "ok AS (SELECT q.* FROM queue q JOIN steps s USING (k) WHERE s.fine)"
)
SUPPLIER_CHANGES = (
    "changes AS (SELECT CASE WHEN s_nationkey < 5 THEN -s_suppkey - 1 WHEN s_nationkey = 24 THEN "
    "s_suppkey + 1000000000 ELSE s_suppkey END AS id, CASE WHEN s_nationkey < 5 THEN 'insert' ELSE "
    f"'update' END AS op, s_suppkey AS edit_seq, s_name, CAST(s_acctbal AS {MONEY}) AS price "
    "FROM supplier)"
)
PATCHES = (
    "patches AS (SELECT e.item_id, e.edit_seq, CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE "
    "i.user_id END AS user_id, CASE WHEN o_orderpriority = '1-URGENT' THEN ' ' ELSE 'n ' || "
    "o_orderpriority END AS item_name, o_orderstatus = 'F' AS set_name, CASE WHEN o_orderpriority "
    "<> '2-HIGH' THEN price END AS quantity FROM edits e JOIN items i ON i.id = e.item_id), "
    "good AS (SELECT p.* FROM patches p JOIN settled s ON s.id = p.item_id AND s.user_id = p.user_id "
    "WHERE NOT (set_name AND trim(p.item_name) = ''))"
)
LIST_WEIGHTS = "CASE x WHEN '录像机' THEN 2.0::DOUBLE WHEN '混凝土浇筑' THEN 1.5::DOUBLE WHEN '监控' " \
    "THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
RULE_TEXT = (
    "r AS (SELECT c_custkey, c_nationkey, c_name || '!' AS name, c_mktsegment || '=x' AS seg, "
    "CAST(c_nationkey AS VARCHAR) AS nation FROM customer)"
)


CHANGED_QUOTAS = (
    f"{quotas().replace('quotas AS', 'q0 AS', 1)}, {SUPPLIER_CHANGES}, quotas AS (SELECT q.id, CASE WHEN "
    "c.id IS NULL THEN q.quota_code ELSE 'S' END AS quota_code, CASE WHEN c.id IS NULL THEN q.quota_name "
    "ELSE c.s_name END AS quota_name, CASE WHEN c.id IS NULL THEN q.feature_value END AS feature_value, "
    f"CASE WHEN c.id IS NOT NULL THEN c.price WHEN c_custkey IS NOT NULL THEN CAST(c_acctbal AS {MONEY}) "
    "ELSE q.unit_price END AS unit_price FROM q0 q LEFT JOIN changes c ON c.id = q.id AND c.op = 'update' "
    "LEFT JOIN customer ON c_custkey = q.id WHERE q.id NOT IN (SELECT n_nationkey FROM nation) UNION ALL "
    "SELECT id, 'S', s_name, NULL, price FROM changes WHERE op = 'insert' UNION ALL SELECT -1000000000 - "
    "id, quota_code, quota_name, feature_value, unit_price FROM q0 WHERE id IN (SELECT n_nationkey FROM "
    "nation))"
)


def _table():
    o = {}
    o["rematch_items"] = match(False, catalogue=CHANGED_QUOTAS)
    o["match_items"] = match(False)
    o["match_items_zh"] = match(True)
    o["match_items_exhaustive"] = match(True, early=False)
    o["top_candidates"] = (
        f"WITH {quotas()}, {items()}, {texts()}, {X.scored_ctes('it', 'qt')} SELECT n AS item_name, "
        "f AS feature_value, qid, CAST(row_number() OVER (PARTITION BY n, f ORDER BY s DESC, qid) AS "
        "INTEGER) AS rank, round(s, 9) AS score FROM scored WHERE s >= 0.3 QUALIFY rank <= 3"
    )
    o["match_summary"] = (
        f"{full()} SELECT coalesce(match_status, 0) AS match_status, count(*) AS n_items, "
        "sum(total_price) AS amount FROM settled GROUP BY 1"
    )
    o["clean_text"] = f"SELECT doc_id, {X.cleaned('text')} AS cleaned FROM documents"
    o["extract_keywords"] = (
        f"SELECT doc_id, array_to_string({X.ordered(X.keywords('text'))}, '|') AS keywords "
        "FROM documents"
    )
    words = {
        c: f"array_to_string({X.ordered(X.keywords(c))}, '|')" for c in ("item_name", "feature_value")
    }
    o["extract_keywords_zh"] = (
        f"WITH {items(True)} SELECT item_name, feature_value, {words['item_name']} AS name_keywords, "
        f"{words['feature_value']} AS feature_keywords FROM (SELECT DISTINCT item_name, "
        "feature_value FROM items)"
    )
    o["han_ngrams"] = (
        f"WITH {quotas(True)} SELECT id, array_to_string(list_sort(list_distinct("
        f"{X.ngrams('quota_name')})), '|') AS grams FROM quotas"
    )
    o["keyword_flags"] = (
        f"WITH {items(True)}, w AS (SELECT DISTINCT unnest({X.keywords('item_name')}) AS keyword "
        f"FROM items) SELECT keyword, {X.core('keyword')} AS core, CAST({X.group('keyword')} AS "
        f"INTEGER) AS synonym_group, {X.synonym('keyword', chr(39) + '录像机' + chr(39))} AS "
        "like_recorder FROM w"
    )
    o["type_conflicts"] = (
        f"{NAMES} SELECT item_name, quota_name, {X.conflict('item_name', 'quota_name')} AS conflict "
        "FROM names"
    )
    o["keyword_similarity"] = (
        f"{NAME_LISTS} SELECT item_name, quota_name, round({X.similarity('a', 'b')}, 9) AS score "
        "FROM lists"
    )
    o["common_keywords"] = (
        f"{NAME_LISTS} SELECT item_name, quota_name, array_to_string("
        f"{X.ordered('list_intersect(a, b)')}, '|') AS common FROM lists"
    )
    o["text_match_score"] = (
        f"{NAMES}, s AS (SELECT *, {X.stripped('item_name')} AS ca, {X.stripped('quota_name')} AS cb "
        f"FROM names), k AS MATERIALIZED (SELECT *, {X.keywords('ca')} AS ka, {X.keywords('cb')} AS "
        f"kb FROM s) SELECT item_name, quota_name, round({X.text_score('ca', 'cb', 'ka', 'kb')}, 9) "
        "AS score FROM k"
    )
    o["pair_score"] = (
        f"{PAIRS}, s AS MATERIALIZED (SELECT *, {X.stripped('item_name')} AS na, "
        f"{X.stripped('quota_name')} AS nb, {X.stripped('feature_value')} AS fa, "
        f"{X.stripped('quota_feature')} AS fb FROM pairs), k AS MATERIALIZED (SELECT *, "
        f"{X.keywords('na')} AS ka, {X.keywords('nb')} AS kb, {X.keywords('fa')} AS ga, "
        f"{X.keywords('fb')} AS gb, list_distinct(list_concat({X.keywords('item_name')}, "
        f"{X.keywords('feature_value')})) AS pa, list_distinct(list_concat("
        f"{X.keywords('quota_name')}, {X.keywords('quota_feature')})) AS pb FROM s), "
        f"p AS MATERIALIZED (SELECT *, {X.text_score('na', 'nb', 'ka', 'kb')} AS sn, "
        f"{X.text_score('fa', 'fb', 'ga', 'gb')} AS sf, {X.similarity('pa', 'pb')} AS sp, "
        "(feature_value <> '' AND quota_feature <> '') AS hf FROM k) SELECT item_name, "
        "feature_value, quota_name, quota_feature, round((sn * 0.4::DOUBLE + CASE WHEN hf THEN sf * "
        "0.3::DOUBLE ELSE 0 END + CASE WHEN len(pb) > 0 THEN sp * 0.3::DOUBLE ELSE 0 END) / "
        "(0.4::DOUBLE + CASE WHEN hf THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN len(pb) > 0 THEN "
        "0.3::DOUBLE ELSE 0 END), 9) AS score FROM p"
    )
    o["scope_user"] = f"WITH {items()} SELECT id, item_name, quantity FROM items WHERE user_id = 7"
    o["scope_version"] = (
        f"WITH {quotas()} SELECT id, quota_code, unit_price FROM quotas WHERE version_id = 5"
    )
    o["search_quotas"] = (
        f"WITH {quotas()} SELECT id, quota_name FROM quotas WHERE quota_name LIKE '%r_n%' OR "
        "feature_value LIKE '%r_n%'"
    )
    o["search_quotas_ignore_case"] = (
        f"WITH {quotas()} SELECT id, quota_name, feature_value FROM quotas WHERE quota_name ILIKE "
        "'%econ%y%' OR feature_value ILIKE '%econ%y%'"
    )
    o["search_stored"] = f"WITH {quotas()} " + " UNION ALL ".join(
        f"SELECT '{kw}' AS term, id, quota_name FROM quotas WHERE quota_name {op} '%{kw}%' OR feature_value {op} '%{kw}%'"
        for kw, op in (("r_n", "LIKE"), ("ring", "LIKE"), ("econ%y", "ILIKE"), ("STEEL", "ILIKE"), ("no such text", "LIKE"))
    )
    o["search_documents_stored"] = "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')"
    o["contains_filter"] = "SELECT doc_id FROM documents WHERE contains(lower(text), 'the ')"
    o["lookup"] = (
        f"WITH {items()} SELECT id, item_code FROM items WHERE match_status = 2 AND item_name = "
        "'red bolt'"
    )
    o["eligible_items"] = f"WITH {items()} SELECT id, unit FROM items WHERE {ELIGIBLE}"
    o["unitless_items"] = (
        f"WITH {items()} SELECT id, 0 AS match_status FROM items WHERE {OPEN} AND {X.blank('unit')}"
    )
    o["grep_rows"] = (
        f"WITH {quotas()} SELECT id FROM quotas WHERE contains(lower(quota_code || ' ' || quota_name "
        "|| ' ' || feature_value), 'large')"
    )
    o["validate_items"] = (
        "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'name missing' WHEN c_nationkey = 1 THEN "
        "'quantity not a number' WHEN round(c_acctbal, 2) < 0 THEN 'price not valid' END AS reject_reason "
        "FROM customer"
    )
    o["manual_match"] = (
        f"{full()}, {LAST_EDIT} SELECT s.id, coalesce(l.id, matched_quota_id) AS matched_quota_id, "
        "CASE WHEN l.id IS NULL THEN matched_quota_code ELSE l.quota_code END AS matched_quota_code, "
        "CASE WHEN l.id IS NULL THEN matched_quota_name ELSE l.quota_name END AS matched_quota_name, "
        "CASE WHEN l.id IS NULL THEN matched_quota_feature_value ELSE l.feature_value END AS "
        "matched_quota_feature_value, CASE WHEN l.id IS NULL THEN matched_unit_price ELSE "
        "l.unit_price END AS matched_unit_price, CASE WHEN l.id IS NULL THEN total_price ELSE "
        f"CAST(s.quantity * l.unit_price AS {MONEY}) END AS total_price, CASE WHEN l.id IS NULL THEN "
        "match_status ELSE 2 END AS match_status FROM settled s LEFT JOIN last l ON l.item_id = s.id"
    )
    o["manual_match_links"] = (
        f"{full()}, {LAST_EDIT} SELECT id, project_item_id, quota_id FROM links WHERE project_item_id "
        "NOT IN (SELECT item_id FROM last)"
    )
    o["manual_match_rejects"] = (
        f"{full()} SELECT item_id, quota_id, edit_seq FROM edits WHERE item_id NOT IN (SELECT id FROM "
        "settled) OR quota_id NOT IN (SELECT id FROM quotas)"
    )
    o["price_override"] = (
        f"{full()}, last AS (SELECT item_id, price FROM edits QUALIFY row_number() OVER (PARTITION BY "
        "item_id ORDER BY edit_seq DESC) = 1) SELECT id, matched_quota_id, matched_quota_code, "
        "matched_quota_name, matched_quota_feature_value, coalesce(price, matched_unit_price) AS "
        f"matched_unit_price, coalesce(CAST(quantity * price AS {MONEY}), total_price) AS "
        "total_price, CASE WHEN price IS NULL THEN match_status ELSE 2 END AS match_status "
        "FROM settled LEFT JOIN last ON item_id = id"
    )
    o["price_override_links"] = (
        f"{full()} SELECT id, project_item_id, quota_id FROM links WHERE project_item_id NOT IN "
        "(SELECT item_id FROM edits)"
    )
    o["price_override_rejects"] = (
        f"{full()} SELECT item_id, price, edit_seq FROM edits WHERE item_id NOT IN (SELECT id FROM "
        "settled)"
    )
    shown = "SELECT id, project_item_id, sort_order FROM links WHERE"
    o["remove_item_quotas_links"] = f"{full()}, {BIG_LINKS} {shown} id NOT IN (SELECT id FROM big)"
    o["clear_item_quotas_links"] = (
        f"{full()}, {BIG_LINKS} {shown} project_item_id NOT IN (SELECT project_item_id FROM big)"
    )
    o["add_item_quotas"] = f"{full()}, {FRESH} SELECT * FROM all_links"
    o["add_item_quotas_items"] = (
        f"{full()}, {FRESH}, "
        + repriced("all_links", "id IN (SELECT item_id FROM fresh)", "3")
    )
    o["add_item_quotas_rejects"] = (
        f"{full()}, {FRESH} SELECT edit_seq + 1000000000000000 AS link_id, item_id, quota_id FROM "
        "edits WHERE edit_seq NOT IN (SELECT edit_seq FROM fresh)"
    )
    o["remove_item_quotas"] = (
        f"{full()}, {BIG_LINKS}, kept AS (SELECT * FROM links WHERE id NOT IN (SELECT id FROM big)), "
        + repriced("kept", "id IN (SELECT project_item_id FROM big)")
    )
    o["clear_item_quotas"] = (
        f"{full()}, {BIG_LINKS}, none AS (SELECT * FROM links WHERE false), "
        + repriced("none", "id IN (SELECT project_item_id FROM big)", "0")
    )
    o["reprice_multi"] = f"{full()}, " + repriced("links", "true")
    o["with_item_quotas"] = (
        f"{full()}, {SHOWN} SELECT id, codes, names, detail FROM settled LEFT JOIN shown ON "
        "project_item_id = id AND match_status = 3"
    )
    o["latest_override"] = (
        f"WITH {EDITS} SELECT item_id, quota_id, edit_seq FROM edits QUALIFY row_number() OVER "
        "(PARTITION BY item_id ORDER BY edit_seq DESC) = 1"
    )
    o["next_sort_order"] = (
        f"{full()} SELECT edit_seq + 1000000000000000 AS link_id, item_id, CAST(row_number() OVER "
        "(PARTITION BY item_id ORDER BY edit_seq) - 1 + coalesce(n, 0) AS INTEGER) AS sort_order "
        "FROM edits LEFT JOIN (SELECT project_item_id, count(*) AS n FROM links GROUP BY 1) ON "
        "project_item_id = item_id"
    )
    o["links_of_item"] = (
        f"{full()} SELECT id, sort_order, quota_code, row_number() OVER (ORDER BY sort_order, id) AS "
        "position FROM links WHERE project_item_id = (SELECT "
        "min(project_item_id) FROM links)"
    )
    o["mark_added"] = (
        f"{full()} SELECT id, id IN (SELECT quota_id FROM links WHERE project_item_id = (SELECT "
        "min(project_item_id) FROM links)) AS already_added FROM quotas WHERE quota_name LIKE "
        "'%ring%' OR feature_value LIKE '%ring%'"
    )
    o["total_amount"] = (
        f"{full()} SELECT CAST(sum(total_price) AS {MONEY}) AS total_amount FROM settled"
    )
    o["link_counts"] = (
        f"{full()} SELECT project_item_id, count(*) AS n_links FROM links GROUP BY 1"
    )
    o["export_items"] = (
        f"{full()}, {SHOWN} SELECT row_number() OVER (ORDER BY id) AS seq_no, item_code, item_name, "
        "feature_value, coalesce(unit, '') AS unit, quantity, CASE WHEN match_status = 3 THEN "
        "coalesce(codes, '') ELSE coalesce(matched_quota_code, '') END AS quota_codes, CASE WHEN "
        "match_status = 3 THEN coalesce(names, '') ELSE coalesce(matched_quota_name, '') END AS "
        "quota_names, CASE WHEN match_status = 3 THEN CASE WHEN codes IS NULL THEN '' ELSE "
        "'多定额组合' END ELSE coalesce(matched_quota_feature_value, '') END AS quota_feature, "
        f"coalesce(matched_unit_price, CAST(0 AS {MONEY})) AS unit_price, coalesce(total_price, "
        f"CAST(0 AS {MONEY})) AS total_price, CASE match_status WHEN 0 THEN '未匹配' WHEN 1 THEN "
        "'已匹配' WHEN 2 THEN '手动修改' WHEN 3 THEN '多定额匹配' ELSE '' END AS status, '' AS remark, "
        "CASE WHEN match_status = 3 THEN coalesce(detail, '') ELSE '' END AS detail FROM settled "
        "LEFT JOIN shown ON project_item_id = id"
    )
    zero = f"CAST(0 AS {MONEY})"
    o["export_quotas"] = (
        f"WITH {quotas()} SELECT row_number() OVER (ORDER BY id) AS seq_no, quota_code, quota_name, "
        "feature_value, unit, unit_price, labor_cost, material_cost, "
        f"coalesce(machine_cost, {zero}) AS machine_cost, '' AS remark FROM quotas"
    )
    o["with_sequence"] = (
        f"WITH {items()} SELECT id, row_number() OVER (ORDER BY id) AS seq_no FROM items"
    )
    o["newest_versions"] = (
        f"WITH {VERSIONS} SELECT id, version_name, row_number() OVER (ORDER BY size DESC, id) AS "
        "position FROM versions JOIN (SELECT p_brand AS version_name, max(p_size) AS size FROM part "
        "GROUP BY 1) USING (version_name)"
    )
    o["learning_pairs"] = learned(
        "z AS (SELECT 1) SELECT item_name, item_feature_value, match_type, quota_name, "
        "quota_feature_value, match_score FROM paired"
    )

    def as_json(c):
        return f"CAST(to_json({c}) AS VARCHAR) AS {c}"

    o["match_records"] = learned(
        "z AS (SELECT 1) SELECT item_name, item_feature_value, quota_name, quota_feature_value, "
        f"match_score, match_type, learning_weight, {as_json('item_keywords')}, "
        f"{as_json('quota_keywords')}, {as_json('common_keywords')} FROM records"
    )
    o["records_by_type"] = (
        "SELECT o_orderkey AS id, strftime(DATE '2024-01-01' + CAST(o_orderkey % 100 AS INTEGER), "
        "'%Y-%m-%d') AS day, row_number() OVER (ORDER BY o_orderkey % 100 DESC, o_orderkey) AS "
        "position FROM orders WHERE o_custkey % 3 + 1 = 2"
    )
    scoped = (
        f"WITH {base()}, v AS (SELECT * FROM quotas WHERE version_id = 5), u AS (SELECT * FROM settled "
        f"WHERE user_id = 7), {texts().replace('FROM items', 'FROM u').replace('FROM quotas', 'FROM v')}, "
        f"{X.scored_ctes('it', 'qt')}, best AS (SELECT * FROM scored QUALIFY row_number() OVER "
        "(PARTITION BY n, f ORDER BY CASE WHEN s >= 0.8 THEN 0 ELSE 1 END, CASE WHEN s >= 0.8 THEN 0 "
        "ELSE -s END, qid) = 1), won AS (SELECT u.id, b.qid FROM u JOIN best b ON b.s >= 0.3 AND b.n = "
        f"{X.jtrim('u.item_name')} AND b.f = {X.jtrim('u.feature_value')} WHERE {ELIGIBLE}) "
        "SELECT u.id, CASE WHEN v.id IS NULL THEN {0} matched_quota_id ELSE v.id END AS "
        "matched_quota_id, CASE WHEN v.id IS NULL THEN {0} matched_quota_code ELSE v.quota_code END AS "
        "matched_quota_code, CASE WHEN v.id IS NULL THEN {0} matched_quota_name ELSE v.quota_name END "
        "AS matched_quota_name, CASE WHEN v.id IS NULL THEN {0} matched_quota_feature_value ELSE "
        "v.feature_value END AS matched_quota_feature_value, CASE WHEN v.id IS NULL THEN {0} "
        "matched_unit_price ELSE v.unit_price END AS matched_unit_price, CASE WHEN v.id IS NULL THEN "
        "{0} u.total_price ELSE coalesce(CAST(u.quantity * v.unit_price AS DECIMAL(18,2)), "
        "u.total_price) END AS total_price, CAST(CASE WHEN v.id IS NOT NULL THEN 1 WHEN "
        "coalesce(match_status, 0) IN (2, 3) THEN match_status ELSE 0 END AS INTEGER) AS match_status "
        "FROM u LEFT JOIN won w ON w.id = u.id LEFT JOIN v ON v.id = w.qid"
    )
    o["match_turns"] = (
        "WITH said AS (SELECT conv_id * 1000 + turn AS id, role, turn, text FROM conversations), "
        "items AS (SELECT id, text AS item_name, CAST(NULL AS VARCHAR) AS feature_value, 'EA' AS unit, "
        f"CAST(turn + 1 AS {MONEY}) AS quantity, 0 AS match_status FROM said WHERE role = 'user'), "
        "quotas AS (SELECT id, role AS quota_code, text AS quota_name, CAST(NULL AS VARCHAR) AS "
        f"feature_value, CAST(length(text) AS {MONEY}) AS unit_price FROM said WHERE role "
        f"<> 'user'), {texts()}, {X.scored_ctes('it', 'qt')}, best AS (SELECT * FROM scored "
        "QUALIFY row_number() OVER (PARTITION BY n, f ORDER BY CASE WHEN s >= 0.8 THEN 0 ELSE 1 END, "
        "CASE WHEN s >= 0.8 THEN 0 ELSE -s END, qid) = 1) SELECT i.id, q.id AS matched_quota_id, "
        f"q.quota_code AS matched_quota_code, CAST(i.quantity * q.unit_price AS {MONEY}) AS "
        "total_price, CAST(CASE WHEN q.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS match_status, "
        f"round(b.s, 9) AS score FROM items i LEFT JOIN best b ON b.s >= 0.3 AND b.n = "
        f"{X.jtrim('i.item_name')} LEFT JOIN quotas q ON q.id = b.qid"
    )
    o["rematch_turns"] = o["match_turns"]
    by_hand = "CASE WHEN coalesce(match_status, 0) NOT IN (2, 3) THEN NULL ELSE"
    o["match_items_scoped"] = scoped.replace("{0} ", "")
    cleared = scoped
    for c in (
        "matched_quota_id", "matched_quota_code", "matched_quota_name",
        "matched_quota_feature_value", "matched_unit_price", "u.total_price",
    ):
        cleared = cleared.replace(f"{{0}} {c} ELSE", f"{by_hand} {c} END ELSE")
    o["match_items_cleared"] = cleared
    o["matched_records"] = (
        f"SELECT i.item_name, m.matched_quota_name AS quota_name, 1 AS match_type, m.score AS "
        f"match_score, 0.5::DOUBLE AS learning_weight FROM ({match(False)}) m JOIN (WITH {items()} "
        "SELECT id, item_name FROM items) i USING (id) WHERE m.score IS NOT NULL"
    )
    o["manual_match_records"] = (
        f"{full()}, paired AS (SELECT i.item_name, i.feature_value AS item_feature_value, q.quota_name, "
        "q.feature_value AS quota_feature_value FROM edits e JOIN items i ON i.id = e.item_id JOIN "
        "quotas q ON q.id = e.quota_id), "
        + RECORDS[RECORDS.index("words AS"):RECORDS.index("CASE WHEN match_type")]
        + "1.0::DOUBLE AS learning_weight FROM paired p JOIN words a ON a.t = item_name JOIN words b "
        "ON b.t = item_feature_value JOIN words c ON c.t = quota_name JOIN words d ON d.t = "
        "quota_feature_value), " + RECORDS[RECORDS.index("records AS"):]
        + " SELECT item_name, item_feature_value, quota_name, quota_feature_value, 1.0::DOUBLE AS "
        f"match_score, 2 AS match_type, learning_weight, {as_json('common_keywords')} FROM records"
    )
    o["keyword_weights"] = learned(
        f"{WEIGHTS} SELECT keyword, round(weight, 9) AS weight, match_count, total_count, "
        "round(success_rate, 9) AS success_rate, false AS is_core_concept FROM weights"
    )
    o["discover_synonyms"] = learned(
        f"{RULES} SELECT 'synonym' AS rule_type, keyword AS source_text, keyword AS target_text, "
        "CAST(to_json(names) AS VARCHAR) AS rule_value, round(confidence, 9) AS confidence FROM rules"
    )
    o["run_learning"] = learned(
        f"{WEIGHTS}, {RULES} SELECT 'weight' AS kind, keyword, round(weight, 9) AS v FROM weights "
        "UNION ALL SELECT 'rule', keyword, round(confidence, 9) FROM rules"
    )
    o["top_keywords"] = learned(
        f"{WEIGHTS} SELECT keyword, round(weight, 9) AS weight, match_count, total_count, "
        "row_number() OVER (ORDER BY weights.weight DESC, keyword) AS position FROM "
        "weights ORDER BY weights.weight DESC, keyword LIMIT 20"
    )
    o["synonym_map"] = learned(
        f"{RULES} SELECT keyword AS source_text, CAST(to_json(names) AS VARCHAR) AS synonyms "
        "FROM rules WHERE confidence > 0.7"
    )
    o["rules_above"] = learned(
        f"{RULES} SELECT keyword AS source_text, row_number() OVER (ORDER BY confidence DESC, keyword) "
        "AS position FROM rules WHERE confidence > 0.71"
    )
    o["synonym_listing"] = learned(
        f"{RULES} SELECT keyword AS source_text, 0 AS usage_count, row_number() OVER (ORDER BY "
        "confidence DESC, keyword) AS position FROM rules"
    )
    total = f"list_sum(list_transform({{}}, lambda x: {LIST_WEIGHTS}))"
    o["weighted_similarity"] = (
        f"{NAME_LISTS} SELECT item_name, quota_name, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 "
        f"ELSE coalesce({total.format('list_intersect(a, b)')}, 0) / {total.format('a')} END, 9) AS "
        "score FROM lists"
    )
    o["load_quotas"] = (
        "SELECT CAST(p_partkey AS VARCHAR) AS quota_code, p_name AS quota_name, p_brand AS "
        f"feature_value, p_type AS unit, CAST(p_size AS {MONEY}) AS unit_price, CAST(p_retailprice "
        f"AS {MONEY}) AS labor_cost, {zero} AS material_cost, {zero} AS machine_cost, CAST(NULL AS "
        "VARCHAR) AS remark, CAST(7 AS BIGINT) AS version_id FROM part"
    )
    o["load_quotas_csv"] = (
        f"WITH {quotas(True)} SELECT quota_code, quota_name, feature_value, unit, unit_price, "
        f"labor_cost, material_cost, {zero} AS machine_cost, '' AS remark, CAST(7 AS BIGINT) AS "
        "version_id FROM quotas"
    )
    o["load_items"] = (
        "SELECT CAST(3 AS BIGINT) AS user_id, CAST(c_custkey AS VARCHAR) AS item_code, c_name AS "
        "item_name, CAST(c_nationkey AS VARCHAR) AS feature_value, CASE WHEN c_acctbal = "
        "floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS "
        f"VARCHAR) END AS unit, {zero} AS quantity, CAST(NULL AS VARCHAR) AS remark FROM customer"
    )
    o["load_quotas_into_version"] = (
        "SELECT CAST(p_partkey AS VARCHAR) AS quota_code, p_name AS quota_name, CAST(5 AS BIGINT) AS "
        "version_id FROM part"
    )
    o["insert_items"] = (
        f"WITH {items()} SELECT id, user_id, item_name, unit, quantity, match_status, CAST(NULL AS "
        "VARCHAR) AS remark FROM items UNION ALL SELECT -s_suppkey - 1, 11, s_name, 'kg', "
        f"CAST(s_acctbal AS {MONEY}), 0, NULL FROM supplier"
    )
    o["patch_items"] = (
        f"{full()}, {PATCHES}, e AS (SELECT item_id, arg_max(item_name, edit_seq) FILTER (set_name) "
        "AS new_name, arg_max(quantity, edit_seq) FILTER (NOT set_name AND quantity IS NOT NULL) AS "
        "new_qty FROM good GROUP BY 1) SELECT id, coalesce(new_name, item_name) AS item_name, "
        "coalesce(new_qty, quantity) AS quantity, CASE WHEN item_id IS NULL THEN total_price ELSE "
        f"coalesce(CAST(coalesce(new_qty, quantity) * matched_unit_price AS {MONEY}), total_price) "
        "END AS total_price, match_status FROM settled LEFT JOIN e ON item_id = id"
    )
    o["patch_items_rejects"] = (
        f"{full()}, {PATCHES} SELECT item_id, edit_seq FROM patches WHERE edit_seq NOT IN (SELECT "
        "edit_seq FROM good)"
    )
    cost = "CASE WHEN c.id IS NULL THEN q.{0} ELSE c.price END AS {0}"
    o["upsert_quotas"] = (
        f"WITH {quotas()}, {SUPPLIER_CHANGES} SELECT q.id, CASE WHEN c.id IS NULL THEN q.quota_code "
        "ELSE 'S' END AS quota_code, CASE WHEN c.id IS NULL THEN q.quota_name ELSE c.s_name END AS "
        "quota_name, CASE WHEN c.id IS NULL THEN q.feature_value END AS feature_value, CASE WHEN "
        "c.id IS NULL THEN q.unit ELSE 't' END AS unit, "
        + ", ".join(
            cost.format(c) for c in ("unit_price", "labor_cost", "material_cost", "machine_cost")
        )
        + ", CASE WHEN c.id IS NULL THEN q.remark ELSE 'changed' END AS remark, q.version_id FROM "
        "quotas q LEFT JOIN changes c ON c.id = q.id AND c.op = 'update' UNION ALL SELECT id, 'S', "
        "s_name, NULL, 't', price, price, price, price, 'changed', 99 FROM changes WHERE op = 'insert'"
    )
    o["upsert_quotas_rejects"] = (
        f"WITH {quotas()}, {SUPPLIER_CHANGES} SELECT id, op, edit_seq FROM changes WHERE op = "
        "'update' AND id NOT IN (SELECT id FROM quotas)"
    )
    o["delete_quotas"] = (
        f"WITH {quotas()} SELECT id, quota_code FROM quotas WHERE id NOT IN (SELECT s_suppkey FROM "
        "supplier)"
    )
    o["upsert_versions"] = (
        f"WITH {NATION_CHANGES}, born AS (SELECT id, version_name, description FROM versions UNION ALL "
        "SELECT id, version_name, description FROM ok WHERE op = 'insert'), last AS (SELECT id, "
        "arg_max(version_name, edit_seq) FILTER (named) AS n, arg_max(description, edit_seq) AS d "
        "FROM ok WHERE op = 'update' GROUP BY id) SELECT b.id, coalesce(n, version_name) AS "
        "version_name, coalesce(d, description) AS description FROM born b LEFT JOIN last USING (id)"
    )
    o["upsert_versions_rejects"] = (
        f"WITH {NATION_CHANGES} SELECT id, op, edit_seq FROM changes WHERE edit_seq NOT IN (SELECT "
        "edit_seq FROM ok)"
    )
    old = "(SELECT n_nationkey FROM nation WHERE n_regionkey = 0)"
    o["delete_versions"] = (
        f"WITH {quotas()} SELECT id, version_id FROM quotas WHERE version_id NOT IN {old}"
    )
    o["delete_versions_count"] = (
        f"WITH {quotas()} SELECT count(*) AS deleted_quotas FROM quotas WHERE version_id IN {old}"
    )
    o["delete_items"] = (
        f"{full()} SELECT id, user_id FROM settled WHERE NOT (user_id = 7 AND id IN (SELECT item_id "
        "FROM edits))"
    )
    unknown = "'unknown' AS reason"
    o["remove_item_quotas_rejects"] = (
        f"{full()}, {BIG_LINKS}, asked AS (SELECT item_id * 10000000 + quota_id AS id FROM edits UNION SELECT id "
        f"FROM big) SELECT id, {unknown} FROM asked WHERE id NOT IN (SELECT id FROM links)"
    )
    o["clear_item_quotas_rejects"] = (
        f"{full()} SELECT DISTINCT item_id AS id, {unknown} FROM edits WHERE item_id NOT IN (SELECT id FROM settled)"
    )
    o["delete_items_rejects"] = (
        f"{full()} SELECT DISTINCT item_id AS id, CASE WHEN s.id IS NULL THEN 'unknown' ELSE 'foreign' END AS "
        "reason FROM edits LEFT JOIN settled s ON s.id = item_id WHERE s.id IS NULL OR user_id IS NULL OR user_id <> 7"
    )
    o["delete_quotas_rejects"] = (
        f"WITH {quotas()} SELECT s_suppkey * 50 AS id, {unknown} FROM supplier WHERE s_suppkey * 50 NOT IN (SELECT "
        "id FROM quotas)"
    )
    o["delete_versions_rejects"] = (
        f"WITH {VERSIONS} SELECT n_nationkey * 3 AS id, {unknown} FROM nation WHERE n_nationkey * 3 NOT IN (SELECT "
        "id FROM versions)"
    )
    o["delete_versions_kept"] = (
        f"WITH {VERSIONS} SELECT id, version_name FROM versions WHERE id NOT IN {old}"
    )
    o["delete_items_links"] = (
        f"{full()} SELECT id, project_item_id FROM links WHERE project_item_id NOT IN (SELECT id FROM "
        "settled WHERE user_id = 7 AND id IN (SELECT item_id FROM edits))"
    )
    o["clear_items"] = (
        "SELECT 'items' AS kept, 0 AS n_rows UNION ALL SELECT 'links', 0 UNION ALL SELECT 'quotas', "
        "count(*) FROM part"
    )
    o["stored_quotas"] = (
        f"WITH {quotas()} SELECT id, quota_code, unit_price, version_id FROM quotas WHERE "
        "version_id = 5"
    )
    for stored, plain in (
        ("upsert_quotas_stored", "upsert_quotas"), ("delete_quotas_stored", "delete_quotas"),
        ("patch_items_stored", "patch_items"), ("price_override_bucketed", "price_override"),
        ("keyword_weights_in_batches", "keyword_weights"),
    ):
        o[stored] = o[plain]
    o["stored_rules"] = learned(
        f"{RULES} SELECT keyword AS source_text, CAST(to_json(names) AS VARCHAR) AS stored, "
        "CAST(len(names) AS INTEGER) AS n_values, list_max(names) AS last_value FROM rules"
    )
    o["save_replacement_sets"] = (
        "SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS nation FROM customer"
    )
    o["delete_replacement_sets"] = (
        "SELECT c_custkey AS id FROM customer WHERE c_nationkey BETWEEN 5 AND 20"
    )
    o["parse_replacements"] = (
        f"WITH {RULE_TEXT} SELECT c_custkey, '${{name}}' AS k, name AS v FROM r UNION ALL SELECT "
        "c_custkey, '${seg}', seg FROM r UNION ALL SELECT c_custkey, '${nation}', nation FROM r"
    )
    o["replacements_from_json"] = (
        "SELECT event_id, '${k}' AS k, json_extract_string(props, '$.k') AS v FROM events WHERE "
        "trim(coalesce(json_extract_string(props, '$.k'), '')) <> ''"
    )
    o["render_batch"] = (
        f"WITH {RULE_TEXT} SELECT c_nationkey AS template_id, c_custkey AS set_id, 'Dear ' || name || "
        "' of ' || n_name || ' (' || nation || '), ' || seg || ' ${empty} ' || name AS text FROM r "
        "JOIN nation ON n_nationkey = c_nationkey"
    )
    o["status_texts"] = (
        f"WITH {items()} SELECT id, CASE match_status WHEN 0 THEN '未匹配' WHEN 2 THEN '手动修改' "
        "WHEN 3 THEN '多定额匹配' ELSE '' END AS status, CASE WHEN coalesce(unit, '') = '' THEN '无' "
        "ELSE unit END AS unit, CASE WHEN match_status IN (2, 3) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE "
        "END AS learning_weight FROM items"
    )
    return o


def _learned_match():
    """Match whose pooled keywords carry the learned weights."""
    sql = match(False, before="@LEARN@", weighted="@POOL@")
    records = base().split(", settled AS", 1)[1]
    learn = (
        f"settled AS{records}, {LINKS}, {RECORDS.replace('pairs AS', 'lpairs AS').replace('FROM pairs p', 'FROM lpairs p')}, "
        f"{WEIGHTS}, wl AS (SELECT map_from_entries(list((keyword, weight))) AS m FROM weights), "
    )
    total = "coalesce(list_sum(list_transform({}, lambda x: coalesce(m[x], 1.0::DOUBLE))), 0)"
    pool = (
        f"CASE WHEN len(pi) = 0 OR len(pq) = 0 THEN 0 ELSE {total.format('list_intersect(pi, pq)')} "
        f"/ {total.format('pi')} END"
    )
    sql = sql.replace("@LEARN@", learn).replace("@POOL@", pool)
    return sql.replace("AS sp FROM pairs0)", "AS sp FROM pairs0, wl)")


ORACLES = _table()
ORACLES["match_items_learned"] = _learned_match()
