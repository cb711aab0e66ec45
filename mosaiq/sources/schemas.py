"""Row types of the manifest tables and of scan sessions."""

from __future__ import annotations

SOURCE = (
    "sourceId string, url string, captureDate string, licenseNote string, locale string, resolution string, gamePatch string, collector string, sourceType string, "
    "workflow string, screenRole string, eligibleHeads array<string>, sourceTags array<string>, originPath string, focusAgentId string, focusAgentIds array<string>, focusAgents array<string>, captureHints variant"
)
RECORD = (
    "id string, sourceId string, sessionId string, matchId string, kind string, head string, state string, locale string, resolution string, path string, labelsPath string, qaStatus string, "
    "sha256 string, frameTsMs double, captureDate string, originalFileName string, dimensions struct<width:int,height:int>, captureHints variant, workflow string, screenRole string, "
    "eligibleHeads array<string>, ocrImportEligible boolean, focusAgentId string, derivedFromRecordId string, derivedFromPath string, labels variant, suggestedLabels variant"
)
SPLITS = "train array<string>, val array<string>, test array<string>"
META = "schemaVersion string, splitSeed long, splitRatio struct<train:double,val:double,test:double>, splits struct<train:array<string>,val:array<string>,test:array<string>>, hardSamplesRef string, privateStorageRoot string, updatedAt string"
CAPTURE = "role string, screenRole string, path string, agentId string, focusAgentId string, slotIndex int, agentSlotIndex int, screenAlias string, alias string, pageIndex int"
DISC = "slot int, setId string, displayName string, level double, levelCap double"
AGENT = f"agentId string, level double, levelCap double, mindscape double, mindscapeCap double, stats map<string,double>, weapon struct<weaponId:string,displayName:string,level:double>, discs array<struct<{', '.join(':'.join(f.split()) for f in DISC.split(', '))}>>, weaponPresent boolean, discSlotOccupancy map<string,boolean>, agentConfidence double, pageIndex int, agentSlotIndex int"


def struct(fields: str) -> str:
    """'a int, b map<..>' -> 'struct<a:int,b:map<..>>'; commas inside brackets stay."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(fields):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(fields[start:k])
            start = k + 1
    parts.append(fields[start:])
    return "struct<" + ",".join(":".join(p.strip().split(" ", 1)) for p in parts) + ">"


SESSION = f"sessionId string, inputLockActive boolean, regionHint string, region string, anchors map<string,boolean>, uidImagePath string, agentIconPaths array<{struct(CAPTURE)}>, screenCaptures array<{struct(CAPTURE)}>, agents array<{struct(AGENT)}>, fullRosterCoverage boolean"
