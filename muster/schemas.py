"""Schemas of the documents and of the tables read from running servers."""

from __future__ import annotations

SERVER = """
  _id string, _type string, description string, mongoVersion string, mongoEdition string,
  address string, serverHome string, cmdOptions map<string,string>,
  seedUsers map<string,array<struct<username:string>>>, environmentVariables map<string,string>
"""

_REF = "struct<`$ref`:string,`$id`:string>"

MEMBER = f"""struct<
  `_id`:int, server:{_REF}, cluster:{_REF}, host:string, arbiterOnly:boolean, buildIndexes:boolean,
  hidden:boolean, priority:int, votes:int, slaveDelay:bigint, tags:map<string,string>>"""

# configServers is one reference or a list, so it is read as JSON text and normalised by refs.edges
CLUSTER = f"""
  _id string, _type string, name string, description string, replKey string,
  members array<{MEMBER}>, configServers string,
  shards array<struct<server:{_REF}, cluster:{_REF}>>, replSetConfigSettings map<string,string>
"""

CONFIG_REF = _REF
CONFIG_LIST = f"array<struct<server:{_REF}, `$ref`:string, `$id`:string>>"

MEMBER_STATUS = """
  cluster_id string, name string, stateStr string, is_self boolean, optimeDate timestamp, errmsg string
"""
MEMBER_CONFIG = """
  cluster_id string, version int, _id int, host string, priority int, votes int, hidden boolean,
  slaveDelay bigint, tags map<string,string>
"""
SERVER_STATUS = """
  server string, ts timestamp, seq bigint, connection boolean, error string, host string, version string,
  connections struct<current:bigint, available:bigint, totalCreated:bigint>
"""
CHANGE_LOG = "key string, op string, ts timestamp, seq bigint, payload string"
ACTIVITY = "op string, ts timestamp, server string, serverDisplayName string, serverDoc string"
INSTALLS = "path string, version string, edition string"
HOSTS = "host string, ips array<string>"
LOG_LINES = "file string, line bigint, value string"
