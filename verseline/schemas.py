"""Schemas of the timed-text tables."""

BOX = "array<array<double>>"
ITEM = f"struct<text:string,confidence:double,box:{BOX}>"
ROW = f"struct<text:string,confidence:double,box:{BOX},x_min:double,x_max:double,y_min:double,y_max:double,x_center:double,y_center:double,width:double,height:double,geometry_available:boolean,items:array<{ITEM}>,source_indices:array<int>>"
OBSERVATION = f"track_id string, source_index long, frame string, time double, raw_text string, display_text string, match_text string, confidence double, box {BOX}, status string, boundaries array<int>, style string"
CANDIDATE = f"struct<frame:string,time:double,raw_text:string,display_text:string,match_text:string,confidence:double,box:{BOX},status:string,boundaries:array<int>>"
SPACE = "struct<position:int,votes:int,compatible_frames:int,ratio:double>"
FOUND_BARE = f"track_id string, kind string, reason string, ordinal long, start_time double, end_time double, text string, confidence double, support_frames long, spaces array<{SPACE}>"
FOUND = f"{FOUND_BARE}, candidates array<{CANDIDATE}>"
EVENT = "type string, event string, job_id string, seq long, timestamp string, stage string, ratio double, current long, total long, message string"
