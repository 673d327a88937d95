"""The same queries as plain SQL for an independent engine.

Where an operator avoids comparing all pairs or cuts hot groups, the SQL here does the naive thing, so the
comparison checks the shortcut.
"""

from __future__ import annotations

ORDER = "line, part, server, price, quantity, optime"

MEMBERS = f"""
members AS (
  SELECT l_orderkey AS cluster, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS server,
         l_extendedprice AS price, l_quantity AS quantity, l_shipdate AS optime,
         l_returnflag = 'N' AS arbiter, l_returnflag = 'R' AS config, l_discount <= 0.02 AS passive,
         CASE WHEN l_linestatus = 'F' THEN 'PRIMARY' ELSE 'SECONDARY' END AS state
  FROM lineitem),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {ORDER}) - 1 AS pos FROM members)"""

SERVERS = """
servers AS (
  SELECT s_suppkey AS server, s_name AS name, s_nationkey AS nation, s_acctbal AS balance,
         s_name || ':' || (s_suppkey + 27000) AS address
  FROM supplier)"""

LEADERS = f"""
leaders AS (
  SELECT * FROM (
    SELECT cluster, server AS leader, optime AS leader_optime, line AS leader_line, part AS leader_part,
           price AS leader_price, row_number() OVER (PARTITION BY cluster ORDER BY {ORDER}) AS rn
    FROM members WHERE state = 'PRIMARY' AND NOT arbiter) WHERE rn = 1)"""

IS_LEADER = "(server = leader AND line = leader_line AND part = leader_part AND price = leader_price)"

INSTALLS = """
parts AS (
  SELECT p_partkey, p_type, p_size // 17 + 1 AS major, p_size % 7 AS minor,
         CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER) AS patch,
         CASE WHEN p_type = 'PROMO' THEN 2 ELSE 3 END AS stage,
         CASE WHEN p_type = 'PROMO' THEN p_size % 3 ELSE 0 END AS stage_no
  FROM part),
installs AS (
  SELECT '/opt/' || p_partkey AS path,
         major || '.' || minor || '.' || patch || CASE WHEN p_type = 'PROMO' THEN '-rc' || stage_no ELSE '' END AS version,
         CASE p_type WHEN 'ECONOMY' THEN 'enterprise' WHEN 'MEDIUM' THEN 'community_ssl'
                     WHEN 'STANDARD' THEN 'community' END AS edition,
         major, minor, patch, stage, stage_no, p_type
  FROM parts)"""

REQUESTS = """
requests AS (
  SELECT s_suppkey AS server,
         CASE WHEN s_acctbal >= 0 THEN s_nationkey // 9 + 1 END AS rmajor,
         CASE WHEN s_acctbal >= 0 THEN s_nationkey % 7 END AS rminor,
         CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal / 400) AS INTEGER) + 1 END AS rpatch,
         CASE WHEN s_nationkey < 8 THEN 'enterprise' WHEN s_nationkey < 16 THEN 'community_ssl'
              ELSE 'community' END AS redition
  FROM supplier)"""

CURRENT = f"""
current_config AS (
  SELECT cluster, line AS id, line AS place, 's' || server || ':1' AS host FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster, line ORDER BY part DESC, server DESC, price DESC, quantity DESC, optime DESC) AS rn
    FROM members WHERE config) WHERE rn = 1)"""

CLASHING = """
clashing AS (
  SELECT cluster, pos, line - 1 AS id, CASE WHEN NOT arbiter THEN server END AS server,
         server || ':' || line AS address
  FROM placed)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


HEADER = "upper(event_type)"
LOG_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0')"

ORACLE: dict[str, str] = {}

# ---- sources and sinks

ORACLE["read_documents"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_name AS address, CAST(s_suppkey + 27000 AS VARCHAR) AS port FROM supplier"""

ORACLE["inline_documents"] = """
SELECT k || c_custkey AS _id, c_name AS description, seq
FROM customer, (VALUES ('a', CAST(0 AS BIGINT)), ('b', CAST(1 AS BIGINT))) AS t(k, seq)"""

ORACLE["stored_documents"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS _id,
       CASE WHEN s_acctbal < 0 THEN 'rejected' WHEN s_acctbal < 5000 THEN 'router' ELSE 'server' END AS type
FROM supplier"""

ORACLE["record_activity"] = """
SELECT event_type AS op, strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events GROUP BY ALL"""

_LOG = f"""
log AS (
  SELECT 'user-' || user_id AS file, event_id * 3 + k AS line, event_id * 3 AS record,
         upper(event_type) AS level, {LOG_TIME} AS ts,
         CASE k WHEN 0 THEN props WHEN 1 THEN 'Traceback (most recent call last):' ELSE '  value ' || user_id END AS message,
         k > 0 AS continued
  FROM events, (VALUES (0), (1), (2)) AS t(k) WHERE k = 0 OR event_type = 'error')"""
ORACLE["parse_log"] = with_(_LOG) + "SELECT * FROM log"
ORACLE["follow_log"] = with_(_LOG) + "SELECT file, level, ts, message, continued, count(*) AS n FROM log GROUP BY ALL"

ORACLE["tail"] = """
SELECT conv_id, turn, role FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3"""

ORACLE["snapshot_roundtrip"] = """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"""

ORACLE["export_manifest"] = """
SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS rows FROM lineitem
WHERE l_linestatus = 'F' OR l_returnflag = 'N' GROUP BY ALL"""

ORACLE["import_snapshot"] = """
SELECT doc_id, lang, n_chars, CASE WHEN n_chars >= 400 THEN 'loaded' ELSE 'rejected' END AS outcome FROM documents"""

ORACLE["replay_changes"] = """
WITH last AS (
  SELECT user_id AS key, event_type, value FROM events
  WHERE event_type IN ('purchase', 'signup', 'error') AND ts <= TIMESTAMP '2024-01-20'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT s_suppkey AS key, s_acctbal AS value FROM supplier WHERE s_suppkey NOT IN (SELECT key FROM last)
UNION ALL SELECT key, value FROM last WHERE event_type <> 'error'"""

# ---- filters and lookups

ORACLE["match_documents"] = with_(MEMBERS) + """
SELECT cluster, line, state FROM members
WHERE state = 'PRIMARY' AND (server = 5 OR part = 5 OR server = 7 OR part = 7)"""

ORACLE["classify_targets"] = """
WITH t AS (
  SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS u FROM events),
parts AS (
  SELECT event_id,
    CASE event_type WHEN 'view' THEN u WHEN 'error' THEN u || '/error/' || u WHEN 'signup' THEN 'mongodb://' || u || ':27017/db'
      WHEN 'purchase' THEN 'x' || u ELSE u || '/' || event_type END AS target FROM t),
split AS (SELECT *, string_split(target, '/') AS p FROM parts),
flags AS (
  SELECT *, len(p) <= 2 AND p[1] IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) AS is_server,
    len(p) <= 2 AND p[1] IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) AS is_cluster,
    target IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation UNION SELECT 'x' || c_nationkey FROM customer) AS is_path,
    starts_with(target, 'mongodb://') AS is_uri
  FROM split)
SELECT event_id, p[1] AS target_id, CASE WHEN len(p) = 2 THEN p[2] END AS database,
  CASE WHEN (is_server OR is_cluster OR is_uri) AND is_path THEN 'ambiguous' WHEN is_uri THEN 'uri'
       WHEN is_server THEN 'server' WHEN is_cluster THEN 'cluster' WHEN is_path THEN 'path' ELSE 'invalid' END AS kind
FROM flags"""

ORACLE["any_member"] = with_(MEMBERS) + "SELECT cluster, bool_or(config) AS has_config FROM members GROUP BY cluster"

ORACLE["pick_first"] = with_(MEMBERS) + f"""
SELECT cluster, server, line, part FROM members WHERE state = 'PRIMARY' AND NOT arbiter
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY {ORDER}) = 1"""

ORACLE["suggest_primary"] = with_(MEMBERS, SERVERS) + f"""
SELECT cluster, m.server, s.address AS server_address FROM members m JOIN servers s ON m.server = s.server
WHERE NOT arbiter AND NOT passive AND config
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY line, part, m.server, price, quantity, optime) = 1"""

ORACLE["first_config"] = with_(MEMBERS) + f"""
SELECT cluster, CASE WHEN quantity > 25 THEN part END AS conf FROM (
  SELECT *, CASE WHEN state = 'PRIMARY' AND passive THEN 0 WHEN arbiter THEN 2 ELSE 1 END AS turn FROM members)
WHERE turn = 0 OR quantity > 25
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY turn, {ORDER}) = 1"""

ORACLE["first_source"] = with_(MEMBERS) + """
SELECT p_partkey AS part, source, source IS NULL AS missing
FROM part LEFT JOIN (SELECT part, min(server) AS source FROM members WHERE config GROUP BY part) ON part = p_partkey"""

# ---- layering and maps

ORACLE["layer_documents"] = """
SELECT key, name, layer FROM (
  SELECT c_custkey AS key, c_name AS name, c_custkey AS seq, CAST(0 AS BIGINT) AS layer FROM customer
  UNION ALL SELECT s_suppkey, s_name, s_suppkey, 1 FROM supplier
  UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, 2 FROM orders)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer DESC, seq DESC) = 1"""

ORACLE["merge_settings"] = """
SELECT o_orderkey,
  CASE WHEN o_totalprice > 100000 THEN 'a=' || o_orderstatus || ',b=x,c=' || o_orderstatus END AS settings,
  CASE WHEN o_totalprice > 100000 THEN 'a=' || o_orderstatus || ',b=x,c=' || o_orderstatus
       ELSE 'a=' || o_orderstatus || ',b=' || o_orderpriority END AS options
FROM orders"""

ORACLE["export_options"] = with_(INSTALLS) + """
, v AS (SELECT *, major * 100 + minor AS mm FROM installs)
SELECT path, concat_ws(',',
  CASE WHEN mm > 204 OR (mm = 204 AND (patch > 0 OR stage = 3)) THEN 'authenticationDatabase=admin' END,
  CASE WHEN mm > 206 OR (mm = 206 AND (patch > 0 OR stage = 3)) THEN 'dumpDbUsersAndRoles=true' END, 'out=/d') AS options
FROM v"""

ORACLE["restore_version"] = """
SELECT c_custkey,
  CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 10 = 7 THEN '3.0.6'
       ELSE '3.' || (c_custkey % 2) || '.' || (c_nationkey % 10) END AS version,
  CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 10 = 7 THEN 'EXACT' ELSE 'EXACT_OR_MINOR' END AS preference
FROM customer"""

ORACLE["config_addresses"] = with_(SERVERS) + """
SELECT nation, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
  CASE WHEN nation % 2 = 0 THEN nation || '/' ELSE '' END || string_agg(address, ',' ORDER BY server) AS replica_address
FROM servers GROUP BY nation"""

ORACLE["gate_options"] = with_(INSTALLS) + """
, v AS (SELECT *, major * 100 + minor AS mm, coalesce(edition, '') = 'enterprise' AS go FROM installs),
p AS (
  SELECT path, go, (mm > 204 OR (mm = 204 AND (patch > 0 OR stage = 3))) AS at24,
    (mm > 206 OR (mm = 206 AND (patch > 0 OR stage = 3))) AS at26,
    (mm > 300 OR (mm = 300 AND (patch > 0 OR stage = 3))) AS at30 FROM v)
SELECT path, concat_ws(',',
  CASE WHEN at24 THEN 'authenticationDatabase=admin' END,
  CASE WHEN go THEN 'continueOnError=true' END,
  CASE WHEN at26 THEN 'restoreDbUsersAndRoles=true' END,
  CASE WHEN at30 AND NOT go THEN 'stopOnError=true' END,
  CASE WHEN at30 THEN 'writeConcern={w:1}' END) AS options
FROM p"""

ORACLE["role_options"] = with_(MEMBERS) + """
SELECT cluster, line, part, concat_ws(',',
  CASE WHEN config THEN 'configsvr=true' END,
  CASE WHEN state <> 'SECONDARY' THEN 'keyFile=/key' END,
  'port=' || (server + 27000),
  CASE WHEN state <> 'SECONDARY' AND NOT passive THEN 'replSet=c' || cluster END,
  CASE WHEN arbiter THEN 'shardsvr=true' END) AS options
FROM members"""

ORACLE["option_inventory"] = """
SELECT o_orderkey, concat_ws(' ',
  CASE WHEN o_orderstatus <> 'O' AND o_custkey <> 0 THEN '--port ' || o_custkey END,
  '--setParameter ' || o_orderpriority || ' --setParameter ' || o_orderstatus,
  CASE WHEN o_orderstatus = 'F' THEN '--shardsvr' END) AS arguments,
  CAST(4 + CASE WHEN o_orderstatus <> 'O' AND o_custkey <> 0 THEN 2 ELSE 0 END
    + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS words
FROM orders"""

ORACLE["typed_option_inventory"] = """
WITH o AS (SELECT o_orderkey, o_orderstatus AS status, o_custkey % 3 AS n FROM orders)
SELECT o_orderkey, concat_ws(' ', '--flagText false', CASE WHEN n <> 0 THEN '--port ' || n END, '--portText ' || n,
  CASE WHEN n <> 0 THEN '--ratio ' || n END,
  '--setParameter ' || status || ' --setParameter 0 --setParameter true', CASE WHEN status = 'F' THEN '--shardsvr' END) AS arguments,
  CAST(10 + CASE WHEN n <> 0 THEN 4 ELSE 0 END + CASE WHEN status = 'F' THEN 1 ELSE 0 END AS BIGINT) AS words
FROM o"""

# ---- joins

ORACLE["cluster_edges"] = """
WITH e AS (
  SELECT c_custkey AS k, 'members' AS role, 0 AS pos, 'server' AS child_kind, c_custkey AS child FROM customer
  UNION ALL SELECT c_custkey, 'shards', 0, 'server', c_nationkey FROM customer
  UNION ALL SELECT c_custkey, 'shards', 1, 'cluster', c_nationkey FROM customer
  UNION ALL SELECT c_custkey, 'configServers', 0, 'cluster', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT c_custkey, 'configServers', i, 'server', c_custkey + i
    FROM customer, (VALUES (0), (1), (2)) AS t(i)
    WHERE i < CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 0 END)
SELECT CAST(k AS VARCHAR) AS cluster_id, role, CAST(pos AS BIGINT) AS pos, child_kind, CAST(child AS VARCHAR) AS child_id,
  'file' AS source FROM e"""

ORACLE["explode_members"] = """
SELECT CAST(c_custkey AS VARCHAR) AS cluster_id, CAST(0 AS BIGINT) AS pos, CAST(c_nationkey AS VARCHAR) AS server_id,
  CAST(NULL AS VARCHAR) AS shard_id FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, NULL, CAST(c_nationkey AS VARCHAR) FROM customer"""

ORACLE["resolve_refs"] = with_(MEMBERS, SERVERS) + """
, m AS (SELECT *, CASE WHEN NOT passive THEN server END AS ref,
          CASE WHEN config THEN 'h' || server || ':1' ELSE 'bad' END AS host FROM members)
SELECT cluster, line, part,
  coalesce(CAST(s.server AS VARCHAR), CASE WHEN ref IS NULL AND config THEN host END, '<Invalid Member>') AS label,
  coalesce(s.address, CASE WHEN ref IS NULL AND config THEN host END) AS server_address
FROM m LEFT JOIN servers s ON s.server = m.ref AND s.balance >= 0"""

_ROLE = "CASE WHEN config THEN 1 WHEN arbiter THEN 3 ELSE 2 END"
ORACLE["owners_of"] = with_(MEMBERS, SERVERS) + f"""
, best AS (
  SELECT server, cluster, {_ROLE} AS r, line FROM members WHERE state = 'PRIMARY'
  QUALIFY row_number() OVER (PARTITION BY server ORDER BY r, cluster, line) = 1)
SELECT s.server, b.cluster AS owner, ['configServers', 'members', 'shards'][r] AS owner_role, b.line AS owner_pos
FROM servers s LEFT JOIN best b ON b.server = s.server"""

ORACLE["owners_by_source"] = with_(MEMBERS) + f"""
, best AS (
  SELECT *, {_ROLE} AS role FROM members
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY state = 'PRIMARY',
    CASE WHEN state = 'PRIMARY' THEN role ELSE 0 END, line, role) = 1)
SELECT p_partkey AS server, b.cluster AS owner, ['configServers', 'members', 'shards'][b.role] AS owner_role,
  b.line AS owner_pos
FROM part LEFT JOIN best b ON b.cluster = p_partkey"""

ORACLE["topology"] = """
SELECT 'region-' || n_regionkey AS root, 'shards' AS role, 'nation-' || n_nationkey AS shard,
  CAST(n_nationkey AS BIGINT) AS shard_pos, coalesce(s_suppkey, 0) AS member_pos, CAST(s_suppkey AS VARCHAR) AS server_id
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"""

ORACLE["topology_addresses"] = with_(SERVERS) + """
SELECT 'nation-' || nation AS shard, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
  'nation-' || nation || '/' || string_agg(address, ',' ORDER BY server) AS replica_address
FROM servers GROUP BY nation"""

ORACLE["cluster_uri"] = with_(MEMBERS, SERVERS) + """
, auth AS (SELECT cluster, bool_or(config) AS auth FROM members GROUP BY cluster),
hosts AS (
  SELECT cluster, string_agg(address, ',' ORDER BY line, part, m.server, price, quantity, optime) AS hosts
  FROM members m JOIN servers s ON s.server = m.server WHERE NOT arbiter GROUP BY cluster)
SELECT cluster, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
  'mongodb://' || CASE WHEN auth THEN '<dbuser>:<dbpass>@' ELSE '' END || hosts
    || CASE WHEN auth THEN '/<dbname>' ELSE '' END || '?replicaSet=' || cluster AS uri
FROM hosts JOIN auth USING (cluster)"""

ORACLE["server_uri"] = with_(SERVERS) + """
SELECT server, CASE WHEN balance > 0 THEN 'mongodb://[dbuser]:[dbpass]@' || address || '/[dbname]'
                    ELSE 'mongodb://' || address END AS uri FROM servers"""

ORACLE["member_roles"] = with_(MEMBERS) + """
SELECT cluster, line, part, arbiter AS is_arbiter, passive AS is_passive,
  NOT arbiter AND NOT passive AS can_become_primary, NOT arbiter AS in_connection,
  config OR o_orderstatus = 'F' AS is_config_server, o_orderstatus = 'O' AS is_shard_server
FROM members JOIN orders ON o_orderkey = cluster"""

ORACLE["match_addresses"] = """
WITH ips AS (SELECT DISTINCT l_orderkey AS host, l_suppkey AS ip FROM lineitem)
SELECT a.o_orderkey, min(b.o_orderkey) AS same_as
FROM orders a JOIN ips i ON i.host = a.o_orderkey
JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P'
JOIN ips j ON j.host = b.o_orderkey AND j.ip = i.ip
WHERE a.o_orderstatus = 'F' GROUP BY a.o_orderkey"""

ORACLE["enrich_status"] = """
SELECT l_orderkey AS cluster, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS name,
  CASE WHEN p_size > 40 THEN CAST(p_size AS BIGINT) END AS "slaveDelay", nullif(p_size, 1) AS priority,
  CASE WHEN p_type = 'SMALL' THEN NULL ELSE CAST(0 AS INTEGER) END AS votes,
  nullif(p_type = 'PROMO', false) AS hidden
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"""

# ---- reconciliation

ORACLE["validate_members"] = with_(MEMBERS, SERVERS) + """
, m AS (
  SELECT *, CASE WHEN quantity <= 40 THEN server END AS ref,
    CASE WHEN quantity > 48 THEN NULL WHEN quantity > 44 THEN 'bad' WHEN quantity > 30 THEN 'good' END AS host,
    config AND line = 7 AS bad_version FROM members)
SELECT cluster, line, part, CASE
  WHEN ref IS NULL AND host IS NULL THEN 'no_server_or_host'
  WHEN host = 'bad' THEN 'bad_host'
  WHEN ref IS NOT NULL AND s.server IS NULL THEN 'unresolved_server'
  WHEN bad_version THEN 'invalid_version'
  WHEN ref IS NOT NULL AND s.balance >= 9000 THEN 'no_address'
  ELSE '' END AS errors
FROM m LEFT JOIN servers s ON s.server = m.ref AND s.balance >= 0"""

ORACLE["validate_servers"] = with_(INSTALLS) + """
SELECT path, CASE
  WHEN edition = 'community' THEN 'invalid_version'
  ELSE concat_ws(',', CASE WHEN major < 1 OR (major = 1 AND minor < 8) THEN 'unsupported_version' END,
                      CASE WHEN edition = 'enterprise' THEN 'unknown_environment_variable' END) END AS errors
FROM installs"""

ORACLE["validate_clusters"] = """
SELECT CAST(c_custkey AS VARCHAR) AS _id,
  CASE WHEN c_acctbal >= 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
       THEN 'config_server_count' ELSE '' END AS errors
FROM customer"""

ORACLE["find_conflicts"] = with_(MEMBERS, CLASHING) + """
SELECT b.cluster, b.pos, kind, min(a.pos) AS first_pos FROM clashing a
JOIN clashing b ON a.cluster = b.cluster AND a.pos < b.pos,
(VALUES ('id'), ('server'), ('address')) AS t(kind)
WHERE (kind = 'id' AND a.id = b.id AND a.id <> 0) OR (kind = 'server' AND a.server = b.server)
   OR (kind = 'address' AND a.address = b.address)
GROUP BY b.cluster, b.pos, kind"""

ORACLE["first_conflict"] = with_(MEMBERS, CLASHING) + """
SELECT a.cluster, a.pos AS first_pos, b.pos, CASE
    WHEN a.id = b.id AND a.id <> 0 THEN 'id' WHEN a.server = b.server THEN 'server' ELSE 'address' END AS kind
FROM clashing a JOIN clashing b ON a.cluster = b.cluster AND a.pos < b.pos
WHERE (a.id = b.id AND a.id <> 0) OR a.server = b.server OR a.address = b.address
QUALIFY row_number() OVER (PARTITION BY a.cluster ORDER BY a.pos, b.pos) = 1"""

ORACLE["find_drift"] = with_(MEMBERS, CURRENT) + """
, declared AS (SELECT cluster, pos, line AS id, 's' || server || ':1' AS address FROM placed WHERE NOT config)
SELECT d.cluster, d.pos, CASE WHEN d.id = c.id THEN 'id_moved' ELSE 'address_renamed' END AS kind, c.id AS current_id
FROM declared d JOIN current_config c ON c.cluster = d.cluster
WHERE (d.id = c.id) <> (d.address = c.host)
QUALIFY row_number() OVER (PARTITION BY d.cluster, d.pos ORDER BY c.place DESC) = 1"""

ORACLE["assign_ids"] = with_(MEMBERS, CURRENT) + """
, declared AS (
  SELECT cluster, pos, CASE WHEN line > 4 THEN line END AS given, 's' || server || ':1' AS address FROM placed),
matched AS (
  SELECT d.*, (SELECT c.id FROM current_config c WHERE c.cluster = d.cluster AND c.host = d.address
               ORDER BY c.place LIMIT 1) AS found,
    (SELECT max(c.id) + 1 FROM current_config c WHERE c.cluster = d.cluster) AS first_new
  FROM declared d)
SELECT cluster, pos, CAST(coalesce(given, found, coalesce(first_new, 0)
  + sum(CASE WHEN given IS NULL AND found IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY cluster ORDER BY pos) - 1)
  AS BIGINT) AS member_id
FROM matched"""

ORACLE["build_desired"] = with_(MEMBERS, CURRENT) + """
, wanted AS (
  SELECT cluster, 0 AS turn, place AS pos, host || '/' AS item FROM current_config
  UNION ALL
  SELECT cluster, 1, pos, 's' || server || '/' || CASE
    WHEN arbiter THEN 'dc=east' WHEN part <> server THEN 'alt=s' || part || ',dc=east' ELSE 'dc=east' END
  FROM placed WHERE passive)
SELECT cluster, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
  string_agg(item, ' ' ORDER BY turn, pos) AS members
FROM wanted GROUP BY cluster"""

_HEADER = """
c AS (SELECT l_orderkey AS k, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey),
header AS (
  SELECT o_orderkey AS cluster, n + 1 AS version,
    CASE WHEN o_totalprice > 250000 THEN concat_ws(',', 'a=' || m, 'b=' || o_orderstatus) END AS settings,
    CASE WHEN o_orderstatus = 'F' THEN true END AS configsvr
  FROM orders LEFT JOIN c ON k = o_orderkey)"""
ORACLE["desired_header"] = with_(_HEADER) + "SELECT * FROM header"

_TO_CONFIGURE = """
declared AS (
  SELECT cluster, pos, CASE WHEN config THEN line + CASE WHEN passive THEN 1 ELSE 0 END END AS id, server,
    's' || server || ':1' AS address, passive,
    CASE WHEN quantity >= 50 THEN 'no_server_or_host' WHEN quantity = 49 THEN 'bad_host'
         WHEN s_acctbal < -900 THEN 'unresolved_server' END AS error
  FROM placed LEFT JOIN supplier ON s_suppkey = server),
clash AS (
  SELECT a.cluster, b.pos, CASE WHEN a.id = b.id THEN 'id' ELSE 'server' END AS detail
  FROM declared a JOIN declared b ON a.cluster = b.cluster AND a.pos < b.pos
  WHERE a.id = b.id OR a.server = b.server
  QUALIFY row_number() OVER (PARTITION BY a.cluster ORDER BY a.pos, b.pos) = 1),
drift AS (
  SELECT d.cluster, d.pos, CASE WHEN d.id = c.id THEN 'id_moved' ELSE 'address_renamed' END AS detail
  FROM declared d JOIN current_config c ON c.cluster = d.cluster
  WHERE (d.id = c.id) <> (d.address = c.host)
  QUALIFY row_number() OVER (PARTITION BY d.cluster, d.pos ORDER BY c.place DESC) = 1),
rejects AS (
  SELECT cluster, reason, pos, detail FROM (
    SELECT cluster, 0 AS turn, 'invalid_member' AS reason, pos, error AS detail FROM declared WHERE error IS NOT NULL
    UNION ALL SELECT cluster, 1, 'conflict', pos, detail FROM clash
    UNION ALL SELECT cluster, 2, 'drift', pos, detail FROM drift)
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY turn, pos) = 1)"""
ORACLE["configuration_rejects"] = with_(MEMBERS, CURRENT, _TO_CONFIGURE) + "SELECT * FROM rejects"
ORACLE["configuration_dry_run"] = with_(MEMBERS, CURRENT, _TO_CONFIGURE, _HEADER) + """
, matched AS (
  SELECT d.*, (SELECT c.id FROM current_config c WHERE c.cluster = d.cluster AND c.host = d.address
               ORDER BY c.place LIMIT 1) AS found,
    (SELECT max(c.id) + 1 FROM current_config c WHERE c.cluster = d.cluster) AS first_new
  FROM declared d WHERE cluster NOT IN (SELECT cluster FROM rejects))
SELECT cluster, pos, address AS host, passive, CAST(coalesce(id, found, coalesce(first_new, 0)
  + sum(CASE WHEN id IS NULL AND found IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY cluster ORDER BY pos) - 1)
  AS BIGINT) AS member_id, version, settings, configsvr
FROM matched LEFT JOIN header USING (cluster)"""

ORACLE["plan_additions"] = """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
ORACLE["already_listed"] = """
SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""

ORACLE["plan_relocation"] = """
SELECT n_regionkey AS shard, s_name AS database, CASE r_name WHEN 'AFRICA' THEN 1 ELSE 99 END AS destination,
  CASE WHEN r_name <> 'AFRICA' THEN 'unknown destination' END AS error
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('AFRICA', 'EUROPE')"""

ORACLE["verify_applied"] = """
WITH c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey),
e AS (
  SELECT o_orderkey AS cluster, CAST(left(o_orderpriority, 1) AS BIGINT) AS expected, o_orderstatus = 'F' AS forced,
    coalesce(n, 0) AS observed FROM orders LEFT JOIN c ON k = o_orderkey)
SELECT *, observed = expected OR (forced AND observed >= expected) AS applied FROM e"""

ORACLE["verify_cache_size"] = """
SELECT o_orderkey, o_orderpriority = '1-URGENT' OR o_orderstatus <> 'F'
  OR CAST(trunc(o_totalprice / 65536 * 1073741824) AS BIGINT) = 1 AS applied FROM orders"""

# ---- health

ORACLE["latest_snapshot"] = """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
ORACLE["status_feed"] = ORACLE["latest_snapshot"]

ORACLE["status_summary"] = """
SELECT CAST(user_id AS VARCHAR) AS server, 'h' || user_id AS host, event_type AS version,
  event_type <> 'error' AS connection, CASE WHEN event_type = 'error' THEN 'Timed Out after ' || user_id END AS error,
  CASE WHEN event_type = 'error' THEN true END AS "timedOut",
  '{"current":' || event_id || ',"available":9}' AS connections
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""

ORACLE["classify_outcome"] = """
SELECT CASE WHEN lower(text) LIKE '%token =%' THEN 'secret' WHEN text LIKE '%@%' THEN 'address'
            WHEN lower(text) LIKE '%license%' THEN 'license' ELSE 'other' END AS outcome, count(*) AS n
FROM documents GROUP BY 1"""

ORACLE["start_outcome"] = """
SELECT event_id,
  CASE WHEN event_type = 'view' THEN NULL WHEN value > 100 THEN 'timed_out' WHEN event_type = 'error' THEN 'port_in_use'
       WHEN event_type = 'click' THEN 'ssl_mismatch' ELSE 'other' END AS at_start,
  CASE WHEN event_type = 'view' THEN NULL WHEN value > 100 THEN 'timed_out' WHEN event_type = 'click' THEN 'ssl_mismatch'
       WHEN event_type = 'error' THEN 'too_many_connections' ELSE 'other' END AS at_stop,
  CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'purchase' THEN 'offline' ELSE 'online' END AS online
FROM events"""

_LAGGING = f"""
lagging AS (
  SELECT m.*, leader, abs(epoch_us(optime) - epoch_us(leader_optime)) / 1e6 AS lag, leader IS NULL AS missing_leader
  FROM members m LEFT JOIN leaders USING (cluster) WHERE state = 'SECONDARY' AND NOT arbiter)"""
ORACLE["lag_to_leader"] = with_(MEMBERS, LEADERS, _LAGGING) + "SELECT cluster, line, part, lag, missing_leader FROM lagging"
_CANDIDATES = """
SELECT cluster, leader, CASE WHEN NOT missing_leader THEN server END AS server,
  CASE WHEN NOT missing_leader THEN passive END AS passive, lag, missing_leader FROM lagging """
ORACLE["rank_candidates"] = with_(MEMBERS, LEADERS, _LAGGING) + _CANDIDATES + f"""
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY NOT passive, lag, {ORDER}) = 1"""
ORACLE["rank_candidates_within_lag"] = with_(MEMBERS, LEADERS, _LAGGING) + _CANDIDATES + f"""
WHERE missing_leader OR lag <= 365 * 86400
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY NOT passive, lag, {ORDER})
  <= CASE WHEN missing_leader THEN 1 ELSE 2 END"""

ORACLE["retention_span"] = """
WITH s AS (
  SELECT user_id, max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) AS seconds FROM events GROUP BY user_id)
SELECT c_custkey AS user_id, seconds, seconds // 3600 AS hours,
  CASE WHEN seconds IS NULL THEN '' ELSE seconds || ' secs (' || (seconds // 3600) || ' hours)' END AS span
FROM customer LEFT JOIN s ON user_id = c_custkey"""

ORACLE["cluster_status"] = with_(MEMBERS, LEADERS) + f"""
, j AS (
  SELECT m.*, l.* EXCLUDE (cluster), coalesce({IS_LEADER}, false) AS own, leader IS NULL AS lost
  FROM members m LEFT JOIN leaders l USING (cluster))
SELECT cluster, min(leader) AS leader, count(*) FILTER (NOT own) AS others,
  strftime(max(optime) FILTER (NOT own), '%Y-%m-%d') AS newest_other,
  count(*) FILTER (NOT own AND optime < leader_optime) AS behind,
  max(abs(epoch_us(optime) - epoch_us(leader_optime)) / 1e6) FILTER (NOT own) AS largest_lag, bool_or(lost) AS missing_leader
FROM j GROUP BY cluster"""

_REPORT = """
top AS (SELECT cluster, max(optime) AS top_optime FROM members WHERE line = 1 GROUP BY cluster),
r AS (
  SELECT members.*, cluster AS cluster_id, CAST(part AS VARCHAR) AS address, top_optime IS NULL AS missing_leader,
    CASE WHEN arbiter THEN 'ARBITER' ELSE state END AS "stateStr", CASE WHEN config THEN 'x' END AS errmsg,
    CASE WHEN NOT arbiter AND state = 'SECONDARY' THEN abs(epoch_us(optime) - epoch_us(top_optime)) / 1e6 END AS lag,
    CASE WHEN part % 11 = 0 THEN 60 END AS "slaveDelay", nullif(part % 3, 1) AS priority,
    CASE WHEN part % 7 = 0 THEN 0 END AS votes, CASE WHEN part % 5 = 0 THEN true END AS hidden,
    CASE WHEN part % 4 = 0 THEN '{"dc":"east"}' END AS tags
  FROM members LEFT JOIN top USING (cluster) WHERE line <> 1),
w AS (SELECT *, CAST(floor(lag) AS BIGINT) AS s FROM r),
t AS (
  SELECT *, CASE WHEN s IS NULL THEN '' ELSE concat_ws(' ',
    CASE WHEN s >= 86400 THEN (s // 86400) || ' day(s)' END, CASE WHEN s >= 3600 THEN (s // 3600 % 24) || ' hour(s)' END,
    CASE WHEN s >= 60 THEN (s // 60 % 60) || ' minute(s)' END, (s % 60) || ' second(s)') END AS lag_text FROM w)"""

ORACLE["cluster_documents"] = with_(MEMBERS, _REPORT) + f"""
, docs AS (
  SELECT cluster_id, string_agg('{{"address":"' || address || '","stateStr":"' || "stateStr" || '"'
    || CASE WHEN errmsg IS NULL THEN '' ELSE ',"errmsg":"x"' END
    || CASE WHEN s IS NULL THEN '' ELSE ',"replLag":{{"value":' || s || ',"description":"' || lag_text || '"}}' END
    || coalesce(',"slaveDelay":' || "slaveDelay", '') || coalesce(',"priority":' || priority, '')
    || coalesce(',"votes":' || votes, '') || CASE WHEN hidden THEN ',"hidden":true' ELSE '' END
    || coalesce(',"tags":' || tags, '') || '}}', ',' ORDER BY {ORDER}) AS others
  FROM t GROUP BY cluster_id),
spans AS (
  SELECT user_id, max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) AS seconds FROM events GROUP BY user_id),
lead AS (
  SELECT * FROM members WHERE line = 1 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY {ORDER}) = 1),
block AS (
  SELECT cluster, '{{"address":"' || part || '","stateStr":"PRIMARY","serverStatusSummary":{{"host":"' || s_name
    || '","connection":' || CASE WHEN s_acctbal >= 0 THEN 'true' ELSE 'false' END || '}},"oplogLength":"'
    || CASE WHEN seconds IS NULL THEN '' ELSE seconds || ' secs (' || (seconds // 3600) || ' hours)' END || '"}}' AS leads
  FROM lead LEFT JOIN supplier ON s_suppkey = server LEFT JOIN spans ON user_id = server)
SELECT cluster_id, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
  '{{"primary":' || coalesce(leads, 'null') || ',"otherMembers":[' || others || ']}}' AS status, leads IS NULL AS missing_leader
FROM docs LEFT JOIN block ON cluster = cluster_id"""

ORACLE["member_report"] = with_(MEMBERS, _REPORT) + """
SELECT cluster_id, address, "stateStr", errmsg, lag, lag_text, missing_leader, CAST("slaveDelay" AS BIGINT) AS "slaveDelay",
  CAST(priority AS INTEGER) AS priority, votes, hidden, tags
FROM t"""

# ---- listings and texts

ORACLE["listing"] = with_(SERVERS) + """
SELECT server, CASE WHEN balance > 0 THEN name ELSE '' END AS description, address AS connect_to FROM servers ORDER BY server"""

ORACLE["cluster_listing"] = with_(MEMBERS, SERVERS) + """
, t AS (
  SELECT cluster, string_agg(coalesce(CAST(s.server AS VARCHAR), '<Invalid Member>'), ', '
    ORDER BY line, part, m.server, price, quantity, optime) AS members
  FROM members m LEFT JOIN servers s ON s.server = m.server AND balance >= 0 GROUP BY cluster)
SELECT o_orderkey, o_orderpriority, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
  '[ ' || coalesce(members, '') || ' ]' AS members
FROM orders LEFT JOIN t ON cluster = o_orderkey"""

ORACLE["show"] = """
SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS document
FROM supplier WHERE s_suppkey = 7"""

ORACLE["redact"] = r"""
WITH r AS (
  SELECT doc_id, text,
    regexp_replace(regexp_replace(regexp_replace(text, '(token = ")[0-9a-f]+(")', '\1****\2', 'g'),
      '(mongodb://)[^\s/@:]+(?::[^\s/@]*)?@', '\1*****:*****@', 'g'), '((?:^|\s)-[up]\s+)([^\s-]\S*)', '\1****', 'g') AS redacted
  FROM documents)
SELECT doc_id, md5(redacted) AS digest,
  CAST(len(regexp_extract_all(text, 'token = "[0-9a-f]+"')) AS BIGINT) AS hits_token,
  CAST(len(regexp_extract_all(text, 'mongodb://[^\s/@:]+(?::[^\s/@]*)?@')) AS BIGINT) AS hits_uri,
  CAST(len(regexp_extract_all(text, '(?:^|\s)-[up]\s+[^\s-]\S*')) AS BIGINT) AS hits_login
FROM r"""

ORACLE["redact_commands"] = """
SELECT c_custkey,
  'export -u **** -p **** --sslPEMKeyPassword **** mongodb://*****:*****@h:1/db' AS masked,
  'export -u **** -p **** --sslPEMKeyPassword **** mongodb://' || c_name || ':****@h:1/db' AS masked_keeping_user
FROM customer"""

ORACLE["redaction_totals"] = r"""
WITH h AS (
  SELECT 'token' AS rule, len(regexp_extract_all(text, 'token = "[0-9a-f]+"')) AS n FROM documents
  UNION ALL SELECT 'mail', len(regexp_extract_all(text, '[\w.]+@[\w.]+')) FROM documents)
SELECT rule, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS rows FROM h GROUP BY rule"""

ORACLE["parse_uris"] = r"""
SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z0-9+.-]+)://', 1)) AS scheme,
  regexp_extract(url, '^[a-zA-Z0-9+.-]+://([^/?#:]*)', 1) AS host,
  coalesce(nullif(regexp_extract(url, '^[a-zA-Z0-9+.-]+://[^/?#]*/([^?#]*)', 1), ''), 'admin') AS database
FROM pages"""

_URIS = """
uris AS (
  SELECT *, c_mktsegment = 'BUILDING' AS login, c_mktsegment = 'MACHINERY' AS several,
    CASE WHEN c_acctbal > 0 THEN 'db' || c_nationkey END AS db FROM customer)"""
ORACLE["parse_fleet_uris"] = with_(_URIS) + """
SELECT c_custkey, CASE WHEN login THEN 'u' || c_custkey END AS username, CASE WHEN login THEN 'p@w' END AS password,
  coalesce(db, 'admin') AS database, several AS is_cluster,
  'mongodb://' || CASE WHEN login THEN '*****:*****@' ELSE '' END || 'h' || c_custkey || ':' || (c_custkey + 1000)
    || CASE WHEN several THEN ',h' || (c_custkey + 1) || ':27017,h' || (c_custkey + 2) || ':5' ELSE '' END
    || coalesce('/' || db, '') AS masked
FROM uris"""
ORACLE["uri_nodes"] = with_(_URIS) + """
SELECT c_custkey, CAST(0 AS BIGINT) AS pos, 'h' || c_custkey || ':' || (c_custkey + 1000) AS host FROM uris
UNION ALL SELECT c_custkey, 1, 'h' || (c_custkey + 1) || ':27017' FROM uris WHERE several
UNION ALL SELECT c_custkey, 2, 'h' || (c_custkey + 2) || ':5' FROM uris WHERE several"""

ORACLE["member_uris"] = with_(_URIS) + """
, n AS (
  SELECT *, 0 AS pos, 'h' || c_custkey || ':' || (c_custkey + 1000) AS host FROM uris
  UNION ALL SELECT *, 1, 'h' || (c_custkey + 1) || ':27017' FROM uris WHERE several
  UNION ALL SELECT *, 2, 'h' || (c_custkey + 2) || ':5' FROM uris WHERE several)
SELECT c_custkey, CAST(pos AS BIGINT) AS pos,
  'mongodb://' || CASE WHEN login THEN 'u' || c_custkey || ':****@' ELSE '' END || host || '/' || coalesce(db, '') AS member_uri
FROM n"""

ORACLE["normalise_address"] = """
WITH s AS (
  SELECT s_suppkey, CASE WHEN s_acctbal > 6000 THEN s_name || ':' || s_nationkey WHEN s_acctbal > 0 THEN s_name END AS a,
    coalesce(CASE WHEN s_nationkey > 10 THEN s_nationkey + 27000 END, 27017) AS p FROM supplier)
SELECT s_suppkey, CASE WHEN contains(a, ':') THEN a ELSE a || ':' || p END AS full_address,
  CASE WHEN contains(a, ':') THEN a ELSE coalesce(a, 'localhost') || ':' || p END AS display_address FROM s"""

ORACLE["humanise_durations"] = """
WITH e AS (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS s FROM events)
SELECT event_id, concat_ws(' ',
  CASE WHEN s >= 86400 THEN (s // 86400) || ' day(s)' END, CASE WHEN s >= 3600 THEN (s // 3600 % 24) || ' hour(s)' END,
  CASE WHEN s >= 60 THEN (s // 60 % 60) || ' minute(s)' END, (s % 60) || ' second(s)') AS duration
FROM e"""

ORACLE["small_columns"] = with_(INSTALLS) + """
SELECT path, version, CAST(length(path) AS BIGINT) AS forked, CAST(replace(path, '/opt/', '') AS BIGINT) AS pid,
  CAST(NULL AS BIGINT) AS no_pid, path AS plain, CAST(1 AS BIGINT) AS listed FROM installs"""

# ---- versions

ORACLE["version_keys"] = with_(INSTALLS) + """
SELECT path, major, minor, patch, stage < 3 AS is_pre,
  major > 1 OR minor > 8 OR (minor = 8 AND (patch > 0 OR stage = 3)) AS supported,
  major > 2 OR (major = 2 AND (minor > 6 OR (minor = 6 AND (patch > 1 OR (patch = 1 AND stage = 3))))) AS modern,
  true AS valid
FROM installs"""

_BY_VERSION = "major DESC, minor DESC, patch DESC, stage DESC, stage_no DESC, path"
_PICKS = f"""
i AS (SELECT *, coalesce(edition, 'community') AS ed FROM installs),
fallback AS (SELECT * FROM i ORDER BY (minor % 2 = 0) DESC, {_BY_VERSION} LIMIT 1),
stable AS (SELECT * FROM i WHERE minor % 2 = 0 ORDER BY {_BY_VERSION} LIMIT 1)"""


def _pick(condition: str) -> str:
    return f"""
SELECT server, path AS match_path, version AS match_version, ed AS match_edition FROM (
  SELECT r.server, c.*, row_number() OVER (PARTITION BY r.server ORDER BY turn, {_BY_VERSION}) AS rn
  FROM requests r LEFT JOIN (
    SELECT r.server AS s, i.*, 1 AS turn FROM requests r JOIN i ON {condition} WHERE rmajor IS NOT NULL
    UNION ALL SELECT r.server, f.*, 2 FROM requests r, fallback f WHERE rmajor IS NULL) c ON c.s = r.server)
WHERE rn = 1"""


_EXACT = "redition = ed AND rmajor = major AND rminor = minor AND rpatch = patch AND stage = 3"
_MINOR = "redition = ed AND rmajor = major AND rminor = minor"
_MATCH = with_(INSTALLS, REQUESTS, _PICKS)
ORACLE["match_versions_exact"] = _MATCH + _pick(_EXACT)
ORACLE["match_versions_latest_minor"] = _MATCH + _pick(_MINOR)
ORACLE["match_versions_major_ge"] = _MATCH + _pick("redition = ed AND major >= rmajor")
ORACLE["match_versions_latest_stable"] = _MATCH + _pick("minor % 2 = 0")
ORACLE["match_versions_default"] = _MATCH + """
SELECT server, path AS match_path, version AS match_version, ed AS match_edition FROM requests, fallback"""
ORACLE["match_versions_exact_or_minor"] = _MATCH + f"""
SELECT server, path AS match_path, version AS match_version, ed AS match_edition FROM (
  SELECT r.server, c.*, row_number() OVER (PARTITION BY r.server ORDER BY turn, {_BY_VERSION}) AS rn
  FROM requests r LEFT JOIN (
    SELECT r.server AS s, i.*, 1 AS turn FROM requests r JOIN i ON {_EXACT}
    UNION ALL SELECT r.server AS s, i.*, 2 AS turn FROM requests r JOIN i ON {_MINOR}
    UNION ALL SELECT r.server, f.*, 3 FROM requests r, fallback f WHERE rmajor IS NULL) c ON c.s = r.server)
WHERE rn = 1"""

ORACLE["classify_edition"] = """
SELECT CASE WHEN p_name LIKE '%red%' THEN 'enterprise' WHEN p_name LIKE '%blue%' THEN 'community_ssl' ELSE 'community' END AS by_output,
  CASE WHEN p_name LIKE '%small%' THEN 'enterprise'
       WHEN p_name LIKE '%ring%' OR (p_name LIKE '%hot%' AND p_name NOT LIKE '%bolt%') THEN 'community_ssl'
       ELSE 'community' END AS by_build, count(*) AS n
FROM part GROUP BY ALL"""

ORACLE["version_inventory"] = with_(INSTALLS) + """
SELECT version, edition, count(*) AS installs, min(path) AS first_location FROM installs GROUP BY version, edition"""

ORACLE["artifact_catalog"] = with_(INSTALLS) + """
, t AS (
  SELECT path, version, major, minor, patch, stage, os_name, bits, dist, e AS edition,
    CASE WHEN bits = '32' THEN 'linux-i686' WHEN os_name = 'osx' AND e = 'community_ssl' THEN 'osx-ssl-x86_64'
         ELSE os_name || '-x86_64' END AS spec,
    major > 2 OR (major = 2 AND (minor > 6 OR (minor = 6 AND (patch > 1 OR (patch = 1 AND stage = 3))))) AS modern
  FROM installs, (VALUES ('linux', '64', 'debian71'), ('osx', '64', NULL), ('linux', '32', 'suse11')) AS p(os_name, bits, dist),
    (VALUES ('community'), ('community_ssl'), ('enterprise')) AS q(e)),
n AS (
  SELECT *, CASE
    WHEN edition = 'community' THEN 'mongodb-' || spec || '-' || version || '.tgz'
    WHEN edition = 'community_ssl' AND (major > 3 OR (major = 3 AND (minor > 0 OR patch > 0 OR stage = 3)))
      THEN 'mongodb-' || spec || coalesce('-' || dist, '') || '-' || version || '.tgz'
    WHEN edition = 'enterprise' THEN 'mongodb-' || spec || CASE WHEN modern THEN '-enterprise-' ELSE '-subscription-' END
      || dist || '-' || version || '.tgz' END AS archive FROM t)
SELECT path, os_name, bits, edition, 'http://' || CASE WHEN edition <> 'enterprise' THEN 'fastdl.mongodb.org'
    WHEN modern THEN 'downloads.10gen.com' ELSE 'downloads.mongodb.com' END || '/' || os_name || '/' || archive AS url, archive
FROM n WHERE archive IS NOT NULL"""

ORACLE["storage_default"] = with_(INSTALLS) + """
, v AS (SELECT *, major * 100 + minor AS mm, (patch > 0 OR stage = 3) AS rel FROM installs)
SELECT path, CASE
  WHEN mm > 302 OR (mm = 302 AND rel) THEN coalesce(edition, '') <> 'community'
  WHEN mm > 300 OR (mm = 300 AND rel) THEN coalesce(edition, '') = 'enterprise' END AS newer_engine
FROM v"""

# ---- activity and streams

_INTERVALS = """
WITH a AS (
  SELECT user_id AS server, epoch_us(ts) AS t, event_id, event_type FROM events WHERE event_type IN ('signup', 'error')),
n AS (
  SELECT *, lead(event_type) OVER w AS next_type, lead(t) OVER w AS next_t FROM a
  WINDOW w AS (PARTITION BY server ORDER BY t, event_id))
SELECT server, t AS started, CASE WHEN next_type = 'error' THEN next_t END AS stopped, next_type IS NULL AS pending
FROM n WHERE event_type = 'signup'"""
ORACLE["lifecycle_intervals"] = _INTERVALS
ORACLE["follow_intervals"] = _INTERVALS

_AWAIT = """
WITH r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
c AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
o AS (
  SELECT r.user_id, r.event_id, r.ts, min(epoch_us(c.ts)) AS confirmed
  FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.ts > r.ts AND c.ts <= r.ts + INTERVAL 20 HOUR
  GROUP BY ALL)
"""
ORACLE["await_outcome"] = _AWAIT + "SELECT user_id, event_id, confirmed, confirmed IS NOT NULL AS met FROM o"
ORACLE["await_outcome_stream"] = ORACLE["await_outcome"]

ORACLE["follow_activity"] = """
SELECT CAST(user_id AS VARCHAR) AS server, event_type AS op, count(*) AS n FROM events GROUP BY ALL"""
