"""Prompt templates. ``{schema}`` and ``{data}`` are filled in per document."""

FORM_TEMPLATE = """\
Below are key/value pairs read from a commercial insurance application form, and the JSON
schema of the record we need.

Fill the record from the pairs. Leave out fields the pairs do not answer, or set them to
null. Reply with one JSON object that fits the schema and with nothing else: no comments,
no Markdown, no trailing commas.

Schema:
{schema}

Pairs:
{data}
"""

VEHICLE_TEMPLATE = """\
Below are detections from a photo of a vehicle (labels, colours, text, faces), key/value
pairs read from a driving licence, and the JSON schema of the record we need.

Take the vehicle's type, brand, model, year and transmission from the labels, its colour
from the dominant colours, and its plate, chassis and engine numbers from the text. Take
the driver from the licence pairs, with dates as YYYY-MM-DD. Set what is not there to null.
Reply with one JSON object that fits the schema and with nothing else: no comments, no
Markdown, no trailing commas.

Schema:
{schema}

Data:
{data}
"""
