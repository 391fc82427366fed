"""Fixed schemas of the model's tables; sources are read with them, never by inference."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    """From "name TYPE!" items, `!` marking columns that are never null."""
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, T._parse_datatype_string(kind.rstrip("!")) if "<" in kind else _KINDS[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


_KINDS = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "STRINGS": T.ArrayType(T.StringType())}

FILES = _schema("file_id BIGINT!,path STRING!,language STRING!,family STRING!,hash STRING!,size BIGINT!,mtime BIGINT!,lines INT!,symbol_count INT!,parse_errors INT!,indexed_at BIGINT!")
SYMBOLS = _schema("id BIGINT!,file_id BIGINT!,seq INT!,ordinal INT!,name STRING!,qualified_name STRING!,kind STRING!,signature STRING!,doc STRING,visibility STRING!,start_line INT!,end_line INT!,start_byte INT!,end_byte INT!,parent_id BIGINT,outline STRINGS!,sig_hash BIGINT!,body_hash BIGINT!,pagerank DOUBLE!")
REFS = _schema("id BIGINT!,file_id BIGINT!,owner_id BIGINT,name STRING!,kind STRING!,line INT!,no_self INT!,recv STRING")
EDGES = _schema("src BIGINT!,dst BIGINT!,kind STRING!,confidence INT!,line INT!,src_file BIGINT!,dst_file BIGINT!")
MEMORIES = _schema("id BIGINT!,kind STRING!,text STRING!,provenance STRING!,created_at BIGINT!,stale_since BIGINT,stale_reason STRING")
ANCHORS = _schema("memory_id BIGINT!,ordinal INT!,symbol_id BIGINT,qualified_name STRING!,path STRING!,sig_hash BIGINT!,body_hash BIGINT!")
UTILITY = _schema("target_kind STRING!,target_id BIGINT!,alpha DOUBLE!,beta DOUBLE!,updated_at BIGINT!")
SIGNALS = _schema("id BIGINT!,target_kind STRING!,target_id BIGINT!,kind STRING!,at BIGINT!")
COACCESS = _schema("a BIGINT!,b BIGINT!,weight DOUBLE!,updated_at BIGINT!")
DRAFTS = _schema("id BIGINT!,kind STRING!,text STRING!,about_symbols STRINGS!,created_at BIGINT!")
META = _schema("key STRING!,value STRING!")

#: Confidence of an edge: its label is its position.
CONFIDENCE = ["guess", "heuristic", "resolved", "exact"]
GUESS, HEURISTIC, RESOLVED, EXACT = range(4)
