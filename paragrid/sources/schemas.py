"""Schemas of the record kinds. Optional fields are null where absent: they are never inferred."""

RUN = "struct<start:int,end:int,text:string,bold:boolean,italic:boolean,underline:boolean,font:string,sz:string,color:string>"
PARAGRAPH = (
    "idx int, text string, en string, en_deleted string, deleted_text string, style string, numId string, ilvl string, p_bold boolean, p_italic boolean, p_rpr_b string, p_rpr_i string, has_track_changes boolean, "
    f"runs array<{RUN}>, en_runs array<struct<start:int,end:int,bold:boolean,italic:boolean>>, tc_segments array<struct<type:string,text:string>>, en_segments array<struct<type:string,en:string>>, "
    "tc_cluster_hits array<struct<type:string,count:int>>"
)
STATE = "validated_indices array<int>, history array<struct<timestamp:string,count:int,indices:array<int>,accept_large_batch:boolean>>"
PART = "path string, part string, content binary, error string"
FINDING = "doc_id long, check string, severity string, idx int, message string"
