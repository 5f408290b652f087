"""Explicit schemas of the saved service responses (never inferred)."""

BLOCK = (
    "struct<Id:string,BlockType:string,EntityTypes:array<string>,Confidence:double,"
    "Text:string,SelectionStatus:string,"
    "Relationships:array<struct<Type:string,Ids:array<string>>>>"
)

FORM_PAGE = (
    "doc_id string, job_id string, page_seq bigint, job_status string, "
    f"status_message string, blocks array<{BLOCK}>"
)

ID_RESULT = f"case_id string, doc_id string, blocks array<{BLOCK}>"

LABEL_FEED = (
    "case_id string, image_id string, "
    "Labels array<struct<Name:string,Confidence:double,Categories:array<struct<Name:string>>>>, "
    "ImageProperties struct<Foreground:struct<DominantColors:array<struct<"
    "SimplifiedColor:string,CSSColor:string,HexCode:string,PixelPercent:double>>>>"
)

TEXT_FEED = (
    "image_id string, "
    "TextDetections array<struct<DetectedText:string,Type:string,Confidence:double,"
    "Geometry:struct<BoundingBox:struct<Width:double,Height:double>>>>"
)

FACE_FEED = (
    "image_id string, "
    "FaceDetails array<struct<Confidence:double,AgeRange:struct<Low:int,High:int>,"
    "Gender:struct<Value:string>,Emotions:array<struct<Type:string,Confidence:double>>>>"
)

IMAGE_FEEDS = {"labels": LABEL_FEED, "text": TEXT_FEED, "faces": FACE_FEED}

# One landed record that already holds all three feeds of an image.
IMAGE_RECORD = (
    LABEL_FEED
    + ", "
    + TEXT_FEED.removeprefix("image_id string, ")
    + ", "
    + FACE_FEED.removeprefix("image_id string, ")
)

MODEL_RESPONSE = "doc_id string, prompt_sha string, body string"

MODEL_BODY = "content array<struct<text:string>>"
