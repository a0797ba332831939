"""Fixed values of the governed metadata domain (enumerations, policies, weights)."""

# --- context kinds and provenance -------------------------------------------------------
MODEL_TYPES = ("physical-model", "logical-model")
CONTEXT_TYPES = (
    "scenario", "topic", "analysis-purpose", "business-object", "metric", "dimension",
    "logical-model", "physical-model", "unknown",
)
TRUSTED = ("EXPLICIT", "DERIVED")
UNTRUSTED = ("INFERRED", "CANDIDATE")
PROVENANCE_RANK = {"EXPLICIT": 3, "DERIVED": 2, "INFERRED": 1, "CANDIDATE": 0}
SPECIAL_FOLDERS = {
    "analysis-purpose": "purposes", "business-object": "business-objects",
    "logical-model": "logical-models", "physical-model": "physical-models",
}

# --- fusion ------------------------------------------------------------------------------
LIST_SECTIONS = (
    "dimensions", "metrics", "scenarios", "analysis_purposes", "attributes", "important_fields",
    "primary_objects", "related_objects", "constraints", "lineage.upstream", "lineage.downstream", "grain",
)
SECTION_AUTHORITY = {
    "summary": ("data_dictionary", "data_dictionaries", "modeling_documents", "kpi_definition", "kpi_kqi", "presales_usecases"),
    "formula": ("kpi_definition", "kpi_kqi", "metrics"),
    "classification.layer": ("asset_catalog", "asset_catalogs", "modeling_documents", "modeling_standards"),
    "topic_domain": ("modeling_documents", "modeling_standards", "asset_catalog", "asset_catalogs"),
    "topic": ("modeling_documents", "modeling_standards", "asset_catalog", "asset_catalogs"),
    "important_fields": ("data_dictionary", "data_dictionaries", "runtime_metadata"),
    "lineage.upstream": ("etl", "runtime_lineage"),
    "lineage.downstream": ("etl", "runtime_lineage"),
    "analysis_purposes": ("presales_usecases", "application_documents", "modeling_documents"),
}

# --- search ------------------------------------------------------------------------------
FACET_ALIASES = {"classification.layer": "layer", "domain": "topic_domain", "scenario.kind": "scenario_kind"}
GOVERNED_FACETS = ("layer", "topic_domain", "topic")
BM25_K1, BM25_B = 1.2, 0.75
RRF_OFFSET = 60
CHANNEL_WEIGHTS = {"exact": 3.0, "bm25": 1.0, "dense": 1.0, "facet": 0.25}
DENSE_FLOOR = 0.25
CANDIDATE_LIMIT = 100
BRANCH_CANDIDATE_LIMIT = 256
ENTITY_CANDIDATE_K = 50
BRANCH_K = 3
HIERARCHY_BUNDLE_K = 8

# --- elements ----------------------------------------------------------------------------
ELEMENT_SECTIONS = (
    "important_fields", "formula", "dimensions", "metrics", "constraints", "grain", "attributes",
    "measurement_point", "record_sources", "metric_catalog", "joins", "runtime_details",
    "primary_objects", "object_attributes",
)
ELEMENT_KINDS = {
    "important_fields": "Field", "attributes": "Attribute", "object_attributes": "Attribute",
    "formula": "Formula", "metric_catalog": "Counter", "joins": "JoinKey",
}
ELEMENT_ALIASES = {"fields": "important_fields", "counters": "metric_catalog", "formulas": "formula", "join_keys": "joins"}

# --- serving -----------------------------------------------------------------------------
INTENT_RELATIONS = {
    "metric_to_models": ("supported_by", "uses_model", "uses_metric", "provides_metric", "implemented_by", "implements_logical_model"),
    "analysis_data_requirement": ("uses_metric", "uses_dimension", "uses_model", "supported_by", "has_purpose", "analyzes", "implements_logical_model"),
    "model_understanding": ("maps_to_business_object", "maps_to_attribute", "implements_logical_model", "has_dimension"),
    "impact_analysis": ("upstream", "downstream", "depends_on", "supported_by", "uses_model", "uses_metric", "implements_logical_model"),
}
LINEAGE_RELATIONS = ("upstream", "downstream", "depends_on", "supported_by", "uses_model")
TWO_HOP_INTENTS = ("analysis_data_requirement", "metric_to_models", "impact_analysis")
OUT_WEIGHT, IN_WEIGHT = 0.75, 0.55
ASPECT_SECTIONS = {
    "business_meaning": ("summary",), "purpose": ("analysis_purposes", "customer_value"),
    "business_object": ("primary_objects", "related_objects", "object_attributes"),
    "metrics": ("metrics", "metric_catalog"), "dimensions": ("dimensions",),
    "fields": ("important_fields", "attributes"), "grain": ("grain",), "formula": ("formula",),
    "constraints": ("constraints",), "attributes": ("attributes", "object_attributes"),
    "counters": ("metric_catalog",), "join_keys": ("joins",),
}
TYPE_ASPECTS = {
    "metric": "metrics", "dimension": "dimensions", "analysis-purpose": "purpose",
    "physical-model": "models", "logical-model": "models", "business-object": "business_object",
}
PAGE_ORDER = (
    ("semantic_role", "Semantic Role"), ("scenario.kind", "Scenario Kind"),
    ("scenario.parent_name", "Parent Scenario Group"), ("application", "Application"),
    ("classification.layer", "Layer"), ("topic_domain", "Topic Domain"), ("topic", "Topic"),
    ("primary_objects", "Primary Business Objects"), ("related_objects", "Related Business Objects"),
    ("grain", "Grain"), ("dimensions", "Dimensions"), ("metrics", "Metrics"),
    ("analysis_purposes", "Analysis Purposes"), ("formula", "Formula"),
    ("customer_value", "Customer Value"), ("measurement_point", "Measurement Point"),
    ("interfaces", "Interfaces"), ("probes", "Probes"),
    ("semantic_reference.sid_domain", "SID Domain"), ("semantic_reference.sid_abe", "SID ABE"),
    ("constraints", "Constraints"),
)
PAGE_FACETS = {
    "layer": "classification.layer", "topic_domain": "topic_domain", "topic": "topic", "grain": "grain",
    "primary_objects": "primary_objects", "sid_domain": "semantic_reference.sid_domain",
    "semantic_role": "semantic_role", "scenario_kind": "scenario.kind", "application": "application",
}

# --- hierarchy ---------------------------------------------------------------------------
VIEWS = {
    "analysis": ("topic", "scenario", "analysis-purpose", "metric", "dimension", "business-object", "logical-model", "physical-model"),
    "domain": ("business-category", "data-domain", "topic-domain", "topic", "business-object", "sub-object", "logical-model", "physical-model"),
    "asset": ("layer", "logical-model", "physical-model", "element"),
}
EDGE_STATUS_RANK = {"CONFIRMED": 3, "DERIVED": 2, "CANDIDATE": 1}
RELATION_VIEWS = {
    "part_of": (("domain", "reverse"), ("analysis", "reverse")),
    "implements_logical_model": (("analysis", "reverse"), ("domain", "reverse"), ("asset", "reverse")),
    "has_purpose": (("analysis", "forward"),),
    "uses_metric": (("analysis", "forward"),),
    "requires_metric": (("analysis", "forward"),),
    "uses_dimension": (("analysis", "forward"),),
    "requires_dimension": (("analysis", "forward"),),
    "uses_model": (("analysis", "forward"),),
    "provides_metric": (("analysis", "reverse"),),
    "maps_to_business_object": (("domain", "reverse"), ("analysis", "reverse")),
}
SECTION_VIEWS = {
    "analysis": (("scenarios", "scenario"), ("analysis_purposes", "analysis-purpose"), ("metrics", "metric"),
                 ("dimensions", "dimension"), ("primary_objects", "business-object")),
    "domain": (("business_category", "business-category"), ("data_domain", "data-domain"), ("topic_domain", "topic-domain"),
               ("topic", "topic"), ("primary_objects", "business-object")),
    "asset": (("classification.layer", "layer"),),
}
TAXONOMY_TRANSITIONS = {
    "domain": {
        "business-category": ("data-domain", "topic-domain", "topic"), "data-domain": ("topic-domain", "topic"),
        "topic-domain": ("topic",), "topic": ("business-object", "sub-object", "logical-model", "physical-model"),
        "business-object": ("sub-object", "logical-model", "physical-model"),
        "sub-object": ("logical-model", "physical-model"), "logical-model": ("physical-model",),
    },
    "analysis": {
        "topic": ("scenario", "analysis-purpose"), "scenario": ("analysis-purpose",),
        "analysis-purpose": ("metric", "dimension", "business-object", "logical-model", "physical-model"),
        "metric": ("logical-model", "physical-model"), "dimension": ("logical-model", "physical-model"),
        "business-object": ("logical-model", "physical-model"), "logical-model": ("physical-model",),
    },
    "asset": {
        "layer": ("logical-model", "physical-model"), "logical-model": ("physical-model",), "physical-model": ("element",),
    },
}
IMPORTANT_ELEMENT_LIMIT = 8
BRANCH_PREVIEW = 1000
SUMMARY_TOP = 12
ARBITRATION = {"threshold": 0.8, "max_views": 2, "keep_ratio": 0.8, "prior": 1.1, "branch_k": 3}

# --- inference ---------------------------------------------------------------------------
FEATURE_SECTIONS = ("tags", "technology", "metrics", "dimensions", "grain", "primary_objects", "important_fields")
FEATURE_WEIGHTS = {
    "tags": 1.0, "technology": 1.0, "metrics": 0.9, "dimensions": 0.9, "grain": 0.8,
    "primary_objects": 0.8, "important_fields": 0.6,
}
FEATURE_REFERENCES = ("implements_logical_model", "upstream", "downstream", "maps_to_business_object")
MAX_NEIGHBORS = 16
FEATURE_LIMIT = 32
AMBIGUITY_MARGIN = 0.15
CONFIDENCE_THRESHOLD = 0.8

# --- coverage, planning and binding --------------------------------------------------------
COVERAGE_RESOLVED = ("SATISFIED", "NOT_APPLICABLE")
RELATION_ASPECTS = {
    "models": ("supported_by", "uses_model", "implements_logical_model"),
    "metrics": ("uses_metric", "provides_metric"),
    "dimensions": ("uses_dimension", "has_dimension"),
    "business_object": ("maps_to_business_object", "maps_to_attribute"),
    "purpose": ("has_purpose", "analyzes"),
}
ENVIRONMENT_ASPECTS = ("models", "metrics", "dimensions", "fields", "grain", "lineage")
ENVIRONMENT_TYPES = {
    "models": ("physical-model", "logical-model", "aggregate-model"), "metrics": ("metric", "measure"),
    "dimensions": ("dimension",), "fields": ("field",),
}
ENVIRONMENT_BACKED = ("metric", "dimension", "measure", "logical-model", "physical-model", "field", "business-attribute")
TYPE_GROUPS = {
    "metric": "metric", "measure": "metric", "logical-model": "model", "physical-model": "model",
    "field": "field", "business-attribute": "field",
}
INTENT_REQUIREMENTS = {
    "metric_to_models": ("metrics", "models"),
    "analysis_data_requirement": ("purpose", "metrics", "dimensions", "models"),
    "model_understanding": ("business_meaning", "business_object", "fields", "grain"),
    "impact_analysis": ("models", "lineage"),
    "generic": ("business_meaning",),
}
INTENT_LIMITS = {
    "metric_to_models": (4, 8, 1600), "analysis_data_requirement": (6, 12, 2800),
    "model_understanding": (4, 8, 2200), "impact_analysis": (4, 8, 2200), "generic": (4, 8, 1400),
}
EXPANSIONS = {
    "fields": ("fields", "attributes"), "attributes": ("attributes", "object_attributes"), "counters": ("counters",),
    "join_keys": ("join_keys",), "grain": ("grain",), "lineage": ("lineage",), "business_object": ("business_mapping",),
    "dimensions": ("dimensions",), "metrics": ("metrics",), "formula": ("formula",), "constraints": ("constraints",),
}
INTENT_VIEWS = {
    "analysis_data_requirement": "analysis", "scenario_exploration": "analysis", "purpose_to_data": "analysis",
    "metric_requirement": "analysis", "model_understanding": "domain", "business_semantic_understanding": "domain",
    "model_classification": "domain", "business_object_exploration": "domain", "topic_exploration": "domain",
    "asset_discovery": "asset", "model_inventory": "asset", "field_discovery": "asset", "layer_exploration": "asset",
    "physical_asset_exploration": "asset",
}
STRONG_ANCHORS = ("dimension", "field", "logical-model", "metric", "physical-model", "stable-id")

# --- modelling classification standard 3.1 --------------------------------------------------
LAYER_ALIASES = {
    "ODS": ("ODS", "源数据标准层", "Original Data Standard", "Original Data Standard Model"),
    "SDL": ("SDL", "主题数据联结层", "主题联结层", "Subject Data Linkage", "Subject Data Linkage Model", "DWD"),
    "ODI": ("ODI", "业务对象洞察层", "对象洞察层", "Object Data Insight", "Object Data Insight Model", "DWS"),
    "ADS": ("ADS", "业务应用层", "应用层", "Application Data Store", "Application Data"),
}
LAYER_APPROXIMATE = {"SDL": ("DWD",), "ODI": ("DWS",)}
CONTROLLED_LAYERS = ("SDL", "ODI")
CLASSIFICATION_VERSION = "modeling-classification-3.1"
DOMAIN_ALIASES = {
    "SDL": {
        "性能": ("性能", "性能域", "Performance", "PERF"), "业务": ("业务", "业务域", "Service", "SER"),
        "用户": ("用户", "用户域", "User", "USER"), "事件": ("事件", "事件域", "Incident", "INC"),
        "规划": ("规划", "规划域", "Planning", "PLAN"), "运维": ("运维", "运维域", "Maintenance", "MAIN"),
        "资源": ("资源", "资源域", "Resource", "RES"),
    },
    "ODI": {
        "用户对象": ("用户对象", "User Object"), "网络对象": ("网络对象", "Network Object"), "业务对象": ("业务对象", "Service Object"),
    },
}
DOMAIN_TOPICS = {
    "性能": ("2/3G CS", "IMS", "2/3G PS", "4G PS", "5G PS", "漫游", "无线性能", "无线覆盖", "无线话务", "终端性能", "家宽终端质量",
            "2H数据质量", "2H语音质量", "宽带接入质量", "家宽宽带质量", "家宽设备质量", "家宽平台质量"),
    "业务": ("2/3G语音", "VoLTE", "VoNR", "CS FB", "EPS FB", "WEB", "视频", "OTT", "Cloud X", "PLC", "视频回传", "IoT", "ToB管道",
            "家宽宽带", "家宽IPTV", "家宽质差", "家宽劣化"),
    "用户": ("投诉", "VIP", "CEI", "NPS", "用户行为", "用户覆盖", "家宽用户", "质差用户"),
    "事件": ("用户事件", "网络事件", "业务事件", "终端事件"),
    "规划": (),
    "运维": ("割接", "变更", "日常"),
    "资源": ("GIS地图", "工参", "协议库", "码号资源", "终端库", "区域配置", "网元配置", "物理站点", "物理机房", "固网设备", "传输设备",
            "数通设备", "NFV设备", "家宽设备", "无线资源", "核心网设备", "5GC设备"),
    "用户对象": ("个人用户",),
    "网络对象": ("小区", "基站", "区域", "网元", "网格"),
    "业务对象": ("应用业务", "家宽业务", "IPTV业务"),
}
TOPIC_ALIASES = {
    "性能": {"Wireless Coverage": "无线覆盖", "Wireless Performance": "无线性能"},
    "事件": {"Network Incident": "网络事件"},
    "用户对象": {"Subscriber": "个人用户"},
    "网络对象": {"Cell": "小区", "Site": "基站", "Network Element": "网元", "Grid": "网格"},
    "业务对象": {"Application Service": "应用业务"},
}
PARTIAL_DOMAINS = ("规划",)
STANDARD_SOURCE_PREFIXES = ("modeling-standard:", "governance:")

# --- business mapping rules -----------------------------------------------------------------
FIELD_OBJECT_RULES = (
    (r"\b(cell[_ ]?id|cgi|ecgi|eci)\b", "Cell"),
    (r"\b(imsi|msisdn|subscriber[_ ]?id)\b", "Subscriber"),
    (r"\b(imei|tac)\b", "Terminal"),
    (r"\b(site[_ ]?id|enodeb|gnodeb|ne[_ ]?id)\b", "Network Element"),
    (r"\b(grid[_ ]?id|longitude|latitude|lon|lat)\b", "Location"),
)
TOPIC_RULES = (
    (r"(rsrp|rsrq|sinr|coverage|覆盖|mr)", ("性能", "无线覆盖")),
    (r"(alarm|告警)", ("事件", "网络事件")),
)
TOPIC_RULE_CONFIDENCE = 0.65
KNOWN_TECHNOLOGY = ("LTE", "5G", "NR", "VoLTE", "VoNR", "IMS", "EPC")
LAYER_WORDS = ("ODS", "SDL", "ODI", "ADS", "DWD", "DWS")

# Fixed: sections disclosed last when an expansion is trimmed.
LATE_SECTIONS = ("hierarchy", "related", "candidates", "conflicts", "hierarchy_provenance")
