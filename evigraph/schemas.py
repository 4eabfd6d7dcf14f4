"""Explicit schemas of the graph documents and tables."""

SOURCE = "struct<label:string,url:string,provider:string>"
SOURCES = f"array<{SOURCE}>"
EVIDENCE = f"struct<basis:string,note:string,sources:{SOURCES}>"
SEED = "struct<name:string,kind:string,zone:string>"
PERIOD = "struct<begin:string,end:string>"

NODE_FIELDS = (
    "id string, label string, type string, roles array<string>, summary string, metadata array<string>, "
    f"aliases array<string>, x double, y double, zone string, starter boolean, eraStart int, "
    f"eraStartEvidence {EVIDENCE}, image string, sources {SOURCES}"
)
EDGE_FIELDS = (
    "id string, source string, target string, type string, label string, strength double, "
    f"context array<string>, year int, sources {SOURCES}"
)


def _struct(fields: str) -> str:
    parts, depth, start = [], 0, 0
    for index, char in enumerate(fields):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(fields[start:index].strip())
            start = index + 1
    parts.append(fields[start:].strip())
    return "struct<" + ",".join(part.replace(" ", ":", 1) for part in parts) + ">"


GRAPH = f"version int, generatedAt string, nodes array<{_struct(NODE_FIELDS)}>, edges array<{_struct(EDGE_FIELDS)}>"
REQUEST_FIELDS = (
    "id string, title string, status string, priority int, scope string, createdAt string, processedAt string, "
    f"instructions string, seeds array<{SEED}>, limits struct<maxSeeds:int,maxCandidates:int>, notes string, "
    "source string, candidateOutput string, error string"
)
INBOX = f"version int, requests array<{_struct(REQUEST_FIELDS)}>"
REQUEST_LIST = f"array<{_struct(REQUEST_FIELDS)}>"

IDENTITY = "struct<id:string,name:string,type:string>"
RELATION = (
    "struct<type:string,label:string,context:string,source_url:string,seed_mb_id:string,seed_is_band:boolean,"
    "strength:double>"
)
PAGE = (
    "struct<title:string,url:string,extract:string,wikidata_id:string,categories:array<string>,"
    "links:array<string>,musicbrainz_artist_ids:array<string>>"
)
CANDIDATE = (
    f"struct<title:string,kind:string,source:string,reason:string,musicbrainz:{IDENTITY},wikipedia:{PAGE},"
    f"documented_relation:{RELATION}>"
)
PACKAGE = (
    "struct<name:string,kind:string,requested_kind:string,suggested_zone:string,"
    f"wikipedia:{PAGE},wikidata:struct<id:string,musicbrainz_artist_ids:array<string>>,musicbrainz:{IDENTITY},"
    f"music_candidates:array<{CANDIDATE}>,link_leads:array<string>,"
    "source_errors:array<struct<source:string,message:string>>>"
)
CANDIDATE_ROW = (
    "id string, run_id string, request_id string, seed_name string, requested_kind string, status string, "
    "confidence double, reason string, review_reason_code string, review_note string, created_at timestamp, "
    f"updated_at timestamp, payload {PACKAGE}"
)
RUN_FILE = (
    "runId string, candidates array<struct<name:string,requested_kind:string,status:string,"
    f"music_candidates:array<{CANDIDATE}>,link_leads:array<string>>>"
)
REVIEW_EVENT = (
    "candidate_id string, previous_status string, status string, reason_code string, note string, origin string, "
    "happened_at timestamp"
)
FACT = (
    "id string, entity_id string, text string, year int, tags array<string>, "
    f"sources {SOURCES}, evidence string, status string, source_fingerprint string, verified_at date, "
    "reviewed_at timestamp"
)
FACT_BATCH = "batchId string, verifiedAt string, sources map<string,array<string>>, facts array<array<string>>"
CLAIM = (
    "entity_id string, property string, statement_id string, rank string, snaktype string, value_id string, "
    "value_time string, value_text string, lat double, lon double, globe string, reference_urls array<string>"
)
PLACEMENT = "node_id string, role string, place_id string, name string, country string, lat double, lon double"
POSITION = "mode string, id string, x double, y double"
