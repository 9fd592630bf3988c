"""Schemas of the lake's tables. Unsigned types are widened by one size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _of(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


#: Table name to column list: fixed values, the lake's data model.
DDL = {
    "reference_sequences": "feature_idx long, sequence_hash string, sequence_length_bp long",
    "reference_sequence_chunks": "feature_idx long, chunk_index int, chunk_data string",
    "reference_taxonomy": "reference_idx long, feature_idx long, domain string, phylum string, class string, `order` string, family string, genus string, species string, strain string, ncbi_taxon_id long",
    "reference_phylogeny": "reference_idx long, node_index long, name string, branch_length double, edge_id long, parent_index long, is_tip boolean, feature_idx long",
    "reference_membership": "reference_idx long, feature_idx long",
    "reference_placements": "reference_idx long, feature_idx long, edge_num int, likelihood double, like_weight_ratio double, distal_length double, pendant_length double",
    "reference_annotation": "annotation_idx long, reference_idx long, feature_idx long, parent_feature_idx long, annotation_id string, source string, annotation_type string, position long, stop_position long, strand string, score double, phase short, attributes map<string,string>",
    "read": "prep_sample_idx long, sequence_idx long, read_id string, sequence1 string, qual1 array<short>, sequence2 string, qual2 array<short>",
    "read_mask": "mask_idx long, prep_sample_idx long, sequence_idx long, reason string, left_trim1 long, right_trim1 long, left_trim2 long, right_trim2 long",
    "alignment": "alignment_idx long, prep_sample_idx long, sequence_idx long, feature_idx long, mate_feature_idx long, flags int, position long, stop_position long, mapq short, cigar string, mate_position long, template_length long, tag_as long, tag_xs long, tag_ys long, tag_xn long, tag_xm long, tag_xo long, tag_xg long, tag_nm long, tag_yt string, tag_md string, tag_sa string",
    "reference_exclusion": "feature_idx long",
    "assembled_sequence": "feature_idx long, sequence_hash string, sequence_length_bp long",
    "assembled_sequence_chunks": "feature_idx long, chunk_index int, chunk_data string",
    "assembly_membership": "prep_sample_idx long, processing_idx long, kind string, bin_id string, feature_idx long",
    "bin_quality": "prep_sample_idx long, processing_idx long, kind string, bin_id string, marker_lineage string, completeness double, contamination double, strain_heterogeneity double, genome_size long, n_contigs long, das_tool_score double, source_binner string",
}


def schema(table: str) -> T.StructType:
    return _of(DDL[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A typed table of no rows; results without rows keep their columns."""
    return spark.createDataFrame([], schema(table))
