"""Record types and enumerations of the knowledge-graph pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The allowed values of the enumerated columns.
SOURCE_TYPES = ("chat", "document", "plain_text", "graphml")
NODE_LABELS = ("Person", "Component", "Task", "Requirement", "Concept", "Decision")
EDGE_RELATIONS = ("ASSIGNED_TO", "DEPENDS_ON", "RELATES_TO", "AGREES_WITH", "MENTIONS", "VOTED_FOR", "VOTED_AGAINST", "RESOLVED_TO")
SECTIONS = {"GENERAL": "general_info", "STACK": "tech_stack", "FUNCTIONAL": "functional_req", "INTERFACE": "ui_ux", "UNKNOWN": "uncategorized"}
#: Sections of a document, in the order they are written; uncategorized nodes are left out.
DOCUMENT_ORDER = ("GENERAL", "FUNCTIONAL", "STACK", "INTERFACE")
UNCATEGORIZED = SECTIONS["UNKNOWN"]

MESSAGE = "source string, pos bigint, id bigint, type string, date string, `from` string, author string, text string, reply_to_message_id bigint"
KEY_VALUE = "struct<key:string,value:string>"
NODE = f"id string, label string, name string, description string, properties array<{KEY_VALUE}>, target_section string"
EDGE = "source string, target string, relation string, evidence string"
SUBGRAPH = (
    "summary string, "
    "nodes array<struct<id:string,label:string,name:string,description:string,"
    f"properties:array<{KEY_VALUE}>,target_section:string>>, "
    "edges array<struct<source:string,target:string,relation:string,evidence:string>>, source_ref string"
)
RAW_ENTITIES = "entities array<struct<name:string,label:string,description:string>>"
MERGE_DECISION = "is_duplicate boolean, target_global_id string, new_id string"
MEMORY = "key_entities array<string>, open_decisions array<string>, resolved_decisions array<map<string,string>>, last_mentioned map<string,string>"
FIXES = "fixes array<struct<action:string,node_id:string,edge_source:string,edge_target:string,new_value:string,reason:string>>"
MERGE_ACTION = "is_duplicate boolean, ids_to_merge array<string>, unified_id string, unified_name string, unified_desc string"
CONFLICT = "id string, category string, description string, options array<struct<id:string,text:string,evidence:string>>, ai_recommendation string"
RESOLUTION = "conflict_id string, selected_option_id string, custom_text string"
SECTION_TEXT = "section_id string, title string, content_markdown string"
GRAPH_CONFLICT = "id string, node_id string, conflicting_values array<string>, description string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def section_or_unknown(section: Column) -> Column:
    """The section value; anything that isn't one is uncategorized."""
    return F.when(section.isin(*SECTIONS.values()), section).otherwise(F.lit(UNCATEGORIZED))
