"""The closed vocabulary: node types, predicates and enumerations, as small dimension tables.

The values below are fixed: they must equal those of the knowledge bases that are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Node types by family.
FAMILIES = {
    "genomic": ["Gene", "Variant", "SequenceFeature", "Structure"],
    "molecular": ["Molecule", "MolecularClass", "BiologicalPathway", "BiologicalFunction"],
    "anatomy": ["Anatomy", "CellType", "Organism"],
    "clinical": ["Disease", "Phenotype", "BiomedicalMeasure", "MethodOrProcedure"],
    "exposome": ["Exposure", "SocialFactor", "Food"],
    "physical": ["Device", "MaterialSample"],
    "provenance": ["Publication", "Study", "Dataset", "Agent", "Population", "GeographicLocation", "Concept", "Other"],
}
PROVENANCE_TYPES = ["Publication", "Study", "Dataset", "Agent"]
TYPE_ALIASES = {
    "SDOH": "SocialFactor",
    "SDoH": "SocialFactor",
    "ClinicalMeasure": "BiomedicalMeasure",
    "Procedure": "MethodOrProcedure",
    "Method": "MethodOrProcedure",
    "GenomicFeature": "Variant",
    "Process": "BiologicalPathway",
    "BiologicalProcess": "BiologicalPathway",
    "ExposureOrFactor": "Exposure",
}
# Predicates.
PREDICATES = [
    "is_a", "part_of", "member_of", "derives_from", "located_in", "expressed_in", "encodes", "interacts_with", "binds", "regulates", "catalyzes", "converts_to",
    "participates_in", "causes", "predisposes_to", "treats", "prevents", "contraindicated_in", "affects_response_to", "has_phenotype", "measures", "associated_with",
    "used_to_study", "reported_in",
]
NEGATABLE = [
    "binds", "interacts_with", "causes", "predisposes_to", "prevents", "treats", "affects_response_to", "associated_with", "expressed_in", "regulates", "has_phenotype",
]
SYMMETRIC = ["interacts_with", "associated_with"]
INVERSES = {"encoded_by": "encodes", "caused_by": "causes", "treated_by": "treats", "produces": "catalyzes"}
KNOWLEDGE_LEVELS = ["knowledge_assertion", "statistical_association", "prediction", "observation", "not_provided"]
AGENT_TYPES = ["manual_agent", "automated_agent", "text_mining_agent", "data_analysis_pipeline", "computational_model", "not_provided"]
# Which types the object of a base predicate may have.
RANGES = {
    "treats": ["Disease", "Phenotype"],
    "prevents": ["Disease", "Phenotype"],
    "has_phenotype": ["Phenotype"],
    "encodes": ["Molecule"],
    "reported_in": PROVENANCE_TYPES,
    "used_to_study": ["Disease", "Phenotype", "BiologicalPathway", "BiologicalFunction", "Gene", "Variant", "Molecule"],
}
NODE_TYPES = [t for types in FAMILIES.values() for t in types]
ALL_PREDICATES = PREDICATES + [f"not_{p}" for p in NEGATABLE]


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of a fixed map, or null: a literal in the plan rather than a join."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def family(node_type: Column) -> Column:
    return F.coalesce(lookup(node_type, {t: f for f, types in FAMILIES.items() for t in types}), F.lit("unknown"))


def dim_node_type(spark: SparkSession) -> DataFrame:
    """name, family, is_provenance."""
    return spark.createDataFrame([(t, f, t in PROVENANCE_TYPES) for f, types in FAMILIES.items() for t in types], "name string, family string, is_provenance boolean")


def dim_predicate(spark: SparkSession) -> DataFrame:
    """name, base, symmetric, negative, negatable."""
    base = lambda p: p.removeprefix("not_") if p.startswith("not_") else p
    return spark.createDataFrame([(p, base(p), base(p) in SYMMETRIC, p.startswith("not_"), p in NEGATABLE) for p in ALL_PREDICATES], "name string, base string, symmetric boolean, negative boolean, negatable boolean")
