"""Schemas of the graph tables."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _b = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One line of a graph file; `ordinal` orders lines as the file does.
RECORD = _struct(ordinal=_l, value=_s)
SEGMENT = _struct(node=_s, seq=_s, length=_l, tags=T.MapType(_s, _s), sn=_s, so=_l, sr=_l, ordinal=_l, raw=_s)
LINK = _struct(src=_s, src_orient=_s, dst=_s, dst_orient=_s, overlap=_s, ordinal=_l, raw=_s)
PATH = _struct(path_id=_l, record_type=_s, name=_s, overlaps=_s, tags=T.ArrayType(_s), sample=_s, hap=_l, seq_id=_s, seq_start=_l, seq_end=_l)
STEP = _struct(path_id=_l, step_rank=_l, node=_s, is_reverse=_b)
NODE_COMMUNITY = _struct(node=_s, community_id=_l)
TRACK = _struct(track_id=_l, source_type=_s, reference=_s, sequence=_s, haplotype=_l, seq_start=_l, seq_end=_l, entry_count=_l)
ENTRY = _struct(track_id=_l, step=_l, start=_l, end=_l, node=_s)
RUN = _struct(path_id=_l, start_step=_l, step_count=_l)
