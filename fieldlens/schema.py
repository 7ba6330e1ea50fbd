"""Fixed values and declared schemas of the camera-trap data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: they must match the archive and labelling formats exactly. ---

MEDIA_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".mp4", ".mpeg", ".mov", ".avi")

MIME_TYPES = (
    "image/png",
    "image/jpeg",
    "image/gif",
    "image/webp",
    "video/mp4",
    "video/mpeg",
    "video/quicktime",
    "video/x-msvideo",
)

REPORT_STATUSES = ("success", "failed", "partial", "empty")

OBSERVATION_TYPES = ("animal", "human", "vehicle", "black", "unclassified", "unknown")

LOG_FIELDS = ("Deployment", "StartDate", "StartTime", "EndDate", "EndTime")

SUMMARY_FIELDS = ("deploymentID", "locationID", "deploymentStart", "deploymentEnd", "cameraModel")

COLLECTION_NAME = r"^R[0-9]{4}(_.+)?$"
DEPLOYMENT_NAME = r"^[Rr][0-9]{4}-([0-9A-Za-z_-]+)(_.+)?$"

NO_DATE = "0000:00:00 00:00:00"

CHUNK_BYTES = 64 * 1024 * 1024

# Volunteer choice -> taxon, one table per labelling workflow.
TAXA_IBERIA = {
    "NOANIMAL": "blank",
    "HUMANORVEHICLE": "human",
    "OTHERSPECIES": "animal",
    "UNRECOGNIZABLE": "unknown",
    "REDDEER": "Cervus elaphus",
    "REDFOX": "Vulpes vulpes",
    "WILDBOAR": "Sus scrofa",
    "CERVIDREDORFALLOWDEER": "Cervidae",
    "COMMONGENET": "Genetta genetta",
    "COW": "Bos taurus",
    "EGYPTIANMONGOOSE": "Herpestes ichneumon",
    "EUROPEANBADGER": "Meles meles",
    "EUROPEANRABBIT": "Oryctolagus cuniculus",
    "FALLOWDEER": "Dama dama",
    "HORSE": "Equus caballus",
    "IBERIANHARE": "Lepus granatensis",
    "IBERIANLYNX": "Lynx pardinus",
    "LEPORIDRABBITORHARE": "Leporidae",
    "BIRD": "Aves",
    "DOMESTICDOG": "Canis familiaris",
}

TAXA_MOUNTAIN = {
    "NOANIMAL": "blank",
    "HUMANORVEHICLE": "human",
    "OTHERSPECIES": "animal",
    "UNRECOGNIZABLE": "unknown",
    "REDDEER": "Cervus elaphus",
    "ROEDEER": "Capreolus capreolus",
    "CERVIDREDORROEDEER": "Cervidae",
    "REDFOX": "Vulpes vulpes",
    "REDSQUIRREL": "Sciurus vulgaris",
    "BROWNBEAR": "Ursus arctos",
    "PINEMARTEN": "Martes martes",
    "MARTENPINEORSTONEMARTEN": "Martes",
    "STONEMARTEN": "Martes foina",
    "CHAMOIS": "Rupicapra rupicapra",
    "EURASIANLYNX": "Lynx lynx",
    "WOLF": "Canis lupus",
    "EUROPEANBADGER": "Meles meles",
    "MARMOT": "Marmota marmota",
    "WILDBOAR": "Sus scrofa",
    "EUROPEANHARE": "Lepus europaeus",
    "DOMESTICDOG": "Canis familiaris",
    "DOMESTICCAT": "Felis catus",
    "STOAT": "Mustela erminea",
    "WEASEL": "Mustela nivalis",
    "MUSTELID": "Mustelidae",
    "BIRDGENERAL": "Aves",
}

# --- Declared schemas ---

FINDINGS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
    ]
)

LOG = T.StructType([T.StructField(name, T.StringType()) for name in LOG_FIELDS])

EXPORT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "classification_id",
            "user_name",
            "user_id",
            "workflow_id",
            "workflow_name",
            "workflow_version",
            "subject_ids",
            "subject_data",
            "annotations",
        )
    ]
)

ANNOTATION_VALUE = "struct<choice:string,answers:map<string,string>>"
ANNOTATIONS = f"array<struct<task:string,value:array<{ANNOTATION_VALUE}>>>"
# For cells whose values include plain strings, which stay text until read one by one.
ANNOTATION_TEXTS = "array<struct<task:string,value:array<string>>>"
SUBJECT_DATA = "map<string,map<string,string>>"
