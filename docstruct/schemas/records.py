"""Record schemas as text, and what follows from them: types, rules, JSON schema.

A field is written ``name:type``; the type is ``str`` if left out. ``!`` after the name
makes it required. Types: ``str int float bool``, a pattern or option set by name,
``{Model}``, ``[Model]`` and ``[str]``. ``>=0`` and ``0..100`` bound a number, ``+``
after a list asks for one element or more.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Option sets.
OPTIONS = {
    "transaction_status": [
        "QUOTE", "ISSUE POLICY", "RENEW", "CHANGE", "REWRITE", "REMARKET", "CANCEL",
    ],
    "billing_plan": ["DIRECT", "AGENCY", "OTHER"],
    "entity_type": [
        "CORPORATION", "LLC", "PARTNERSHIP", "INDIVIDUAL", "SOLE PROPRIETOR", "JOINT VENTURE",
        "NON-PROFIT", "OTHER",
    ],
    "city_limits": ["INSIDE", "OUTSIDE"],
    "applicant_type": ["OWNER", "MANAGER", "OFFICER", "PARTNER", "OTHER"],
    "phone_type": ["HOME", "BUS", "CELL", "FAX"],
    "interest": ["OWNER", "TENANT", "LESSEE", "OTHER"],
    "additional_interest_type": [
        "MORTGAGEE", "LOSS PAYEE", "LIENHOLDER", "ADDITIONAL INSURED", "CERTIFICATE HOLDER",
        "OTHER",
    ],
    "evidence": ["CERTIFICATE", "POLICY", "BOTH"],
}

# Patterns, searched anywhere in the text unless anchored. The tax id is
# anchored on one side per branch, as its senders rely on; ``strict_tax_id`` is whole.
PATTERNS = {
    "date": r"^\d{2}/\d{2}/\d{4}$",
    "tax_id": r"^\d{2}-?\d{7}|\d{3}-?\d{2}-?\d{4}$",
    "strict_tax_id": r"^(\d{2}-?\d{7}|\d{3}-?\d{2}-?\d{4})$",
    "state": r"^[A-Z]{2}$",
    "zip": r"^\d{5}(-\d{4})?$",
}

#: How a value of each pattern is written, for prompts.
_FORMATS = {
    "date": "a date as MM/DD/YYYY",
    "tax_id": "an employer number (12-3456789) or a social security number (123-45-6789)",
    "strict_tax_id": "an employer number (12-3456789) or a social security number (123-45-6789)",
    "state": "a state as two capital letters",
    "zip": "a postal code of five digits, or of nine as 12345-6789",
}
_DATE = re.compile(r"(?i)date|expir|birth")

# Fields of the insurance form record, in record order.
FORM_MODELS = {
    "Header": "application_date:date policy_number agency_customer_id",
    "Agency": "name contact_name phone email:email",
    "Carrier": "name naic_code program_name program_code underwriter",
    "Transaction": "status:transaction_status code subcode effective_date_time",
    "Line": "line_name premium:float>=0",
    "Term": (
        "effective_date:date expiration_date:date billing_plan:billing_plan payment_plan "
        "method_of_payment audit deposit:float>=0 minimum_premium:float>=0 "
        "total_policy_premium:float>=0"
    ),
    "Insured": (
        "name!:str mailing_address business_phone website entity_type:entity_type "
        "fein_or_ssn:tax_id gl_code sic_code naics_code"
    ),
    "Contact": "type:applicant_type name phone_type:phone_type phone email:email",
    "Premise": (
        "location_number building_number street city state:state zip:zip county "
        "city_limits:city_limits interest:interest num_employees_full_time:int>=0 "
        "num_employees_part_time:int>=0 annual_revenues:float>=0 occupied_area_sq_ft:float>=0 "
        "open_to_public_area_sq_ft:float>=0 total_building_area_sq_ft:float>=0 "
        "description_of_operations leased_to_others:bool"
    ),
    "Business": (
        "nature_of_business date_business_started:date description_primary_operations "
        "description_other_named_insured_ops"
    ),
    "Item": "location building vehicle item_description",
    "Interest": (
        "interest_type:additional_interest_type name_and_address rank evidence:evidence "
        "send_bill:bool interest_in_item:{Item} reference_loan_number lien_amount:float>=0 "
        "reason_for_interest interest_end_date"
    ),
    "Subsidiary": "parent_name relationship percent_owned:float0..100",
    "Safety": "safety_manual:bool safety_position:bool monthly_meetings:bool osha:bool",
    "General": (
        "is_subsidiary:bool subsidiary_details:{Subsidiary} has_subsidiaries:bool "
        "formal_safety_program:bool safety_program_details:{Safety} flammables_exposure:bool "
        "other_insurance_with_company:bool policy_declined_cancelled_nonrenewed:bool "
        "past_losses_abuse_discrimination:bool convicted_of_fraud_arson:bool "
        "uncorrected_fire_safety_violations:bool foreclosure_bankruptcy_last_5_years:bool "
        "judgement_lien_last_5_years:bool business_in_trust:bool trust_name "
        "foreign_operations:bool other_business_ventures_not_covered:bool "
        "owns_operates_drones:bool hires_drone_operators:bool remarks"
    ),
    "Prior": (
        "year_label general_liability_carrier general_liability_policy_number "
        "general_liability_premium:float>=0 automobile_carrier automobile_policy_number "
        "automobile_premium:float>=0 property_carrier property_policy_number "
        "property_premium:float>=0 other_carrier other_policy_number other_premium:float>=0 "
        "effective_date expiration_date"
    ),
    "Loss": (
        "date_of_occurrence line_of_business description date_of_claim amount_paid:float>=0 "
        "amount_reserved:float>=0 subrogation:bool claim_open:bool"
    ),
    "History": (
        "no_losses:bool years_checked:int1..10 total_losses_amount:float>=0 losses:[Loss]"
    ),
    "Signature": (
        "privacy_notice_given:bool applicant_initials producer_signature producer_name "
        "applicant_signature date:date state_producer_license_no national_producer_number"
    ),
    "Root": (
        "header:{Header} agency_info:{Agency} carrier_info:{Carrier} "
        "transaction_info:{Transaction} lines_of_business:[Line] attachments:[str] "
        "policy_term!:{Term} named_insureds!:[Insured]+ applicant_contact:{Contact} "
        "premises_information:[Premise] business_description:{Business} "
        "additional_interests:[Interest] general_information:{General} prior_carriers:[Prior] "
        "loss_history:{History} signature_info:{Signature}"
    ),
}

# Fields of the vehicle and driver record, in record order.
VEHICLE_MODELS = {
    "Vehicle": (
        "type brand model year:int transmission licensePlate chassisNumber engineNumber color"
    ),
    "Driver": (
        "driverLicenseId name surname dateOfBirth countryOfBirth validFrom validTo "
        "issuingAuthority address addressMatchesDVLA:bool"
    ),
    "Root": "vehicle!:{Vehicle} driver!:{Driver}",
}

_FIELD = re.compile(
    r"(?P<name>\w+)(?P<required>!?)(:(?P<type>\{\w+\}|\[\w+\]|[a-z_]+)"
    r"(?P<plus>\+?)(>=(?P<ge>\d+)|(?P<lo>\d+)\.\.(?P<hi>\d+))?)?$"
)
_SCALARS = {
    "str": T.StringType(),
    "float": T.DoubleType(),
    "int": T.LongType(),
    "bool": T.BooleanType(),
}

RULES_DDL = (
    "schema string, path_norm string, rule string, type string, nullable boolean, "
    "args array<string>, lo double, hi double"
)
RULES_OF_PATH = f"array<struct<{','.join(c.replace(' ', ':', 1) for c in RULES_DDL.split(', '))}>>"


@dataclass(frozen=True)
class Field:
    name: str
    required: bool
    kind: str  # str, int, float, bool, object or list
    model: str | None = None
    options: str | None = None
    pattern: str | None = None
    email: bool = False
    min_items: int | None = None
    lo: float | None = None
    hi: float | None = None


@dataclass(frozen=True)
class Record:
    name: str
    models: dict[str, list[Field]] = field(hash=False)
    closed_root: bool = False

    def struct(self, model: str = "Root") -> T.StructType:
        return T.StructType(
            [T.StructField(f.name, self.field_type(f)) for f in self.models[model]]
        )

    def field_type(self, f: Field) -> T.DataType:
        if f.kind == "object":
            return self.struct(f.model)
        if f.kind == "list":
            return T.ArrayType(self.struct(f.model) if f.model else T.StringType())
        return _SCALARS[f.kind]

    def rules(self) -> list[tuple]:
        out: list[tuple] = []
        self._model_rules("", "Root", out)
        return out

    def rules_by_path(self) -> Column:
        """Constant ``map<path_norm, rules>`` of a few hundred rules, fixed by the schema.

        Built from literals, so Spark evaluates it once and not for every row.
        """

        def literal(value: object) -> str:
            if value is None:
                return "null"
            if isinstance(value, bool):
                return str(value).lower()
            if isinstance(value, list):
                return f"array({', '.join(map(literal, value))})"
            if isinstance(value, str):
                return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
            return f"{float(value)!r}D"

        columns = [c.split(" ", 1) for c in RULES_DDL.split(", ")]
        by_path: dict[str, list[str]] = {}
        for r in self.rules():
            fields = (
                f"'{name}', cast({literal(value)} as {kind})"
                for (name, kind), value in zip(columns, r, strict=True)
            )
            by_path.setdefault(r[1], []).append(f"named_struct({', '.join(fields)})")
        entries = (f"{literal(at)}, array({', '.join(rs)})" for at, rs in by_path.items())
        return F.expr(f"map({', '.join(entries)})")

    def _model_rules(self, path: str, model: str, out: list[tuple]) -> None:
        def add(at, rule, kind, nullable=True, args=None, lo=None, hi=None):
            out.append((self.name, at, rule, kind, nullable, args, lo, hi))

        fields = self.models[model]
        required = [f.name for f in fields if f.required]
        if required:
            add(path, "required", "object", args=required)
        if not path and self.closed_root:
            add(path, "extra", "object", args=[f.name for f in fields])
        for f in fields:
            at = f"{path}.{f.name}" if path else f.name
            nullable = not f.required
            if f.options:
                add(at, "enum", "str", nullable, OPTIONS[f.options])
            else:
                add(at, "type", f.kind, nullable)
            if f.pattern:
                add(at, "pattern", "str", args=[f.pattern])
            if f.email:
                add(at, "email", "str")
            if f.lo is not None:
                add(at, "range", f.kind, lo=f.lo, hi=f.hi)
            if f.min_items:
                add(at, "min_items", "list", lo=float(f.min_items))
            if f.kind == "object":
                self._model_rules(at, f.model, out)
            elif f.kind == "list":
                add(f"{at}[]", "type", "object" if f.model else "str", nullable=False)
                if f.model:
                    self._model_rules(f"{at}[]", f.model, out)

    def depth(self, model: str = "Root") -> int:
        """Levels of keys and elements between the root and the deepest field."""
        extra = {"object": 0, "list": 1}
        return 1 + max(
            extra.get(f.kind, 0) + (self.depth(f.model) if f.model else 0)
            for f in self.models[model]
        )

    def json_schema(self) -> str:
        """JSON schema text for prompts: optional fields may be null, and every field says in
        words what its name abbreviates and in what form and unit its value is wanted."""

        def optional(f: Field, out: dict) -> dict:
            if not f.required:
                out["type"] = [out["type"], "null"]
                if "enum" in out:
                    out["enum"] = [*out["enum"], None]
            return {**out, "description": f"{spelled(f.name)}: {wanted(f)}"}

        def wanted(f: Field) -> str:
            if f.pattern:
                return _FORMATS[f.pattern]
            if f.options:
                return "one of the listed values, in capitals"
            if f.email:
                return "an e-mail address"
            if f.kind == "bool":
                return "true if marked or answered yes, false if answered no"
            if f.kind in ("int", "float"):
                kind = "a whole number" if f.kind == "int" else "a number without currency sign or commas"
                if f.hi is not None:
                    return f"{kind} from {f.lo:g} to {f.hi:g}"
                return kind if f.lo is None else f"{kind}, {f.lo:g} or more"
            if f.kind == "list":
                return "one entry for each that the document lists, in its order"
            if f.kind == "object":
                return "the fields of this part of the document"
            if _DATE.search(f.name):
                return "a date as the document writes it"
            return "text as the document writes it"

        def spelled(name: str) -> str:
            apart = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)
            return apart.replace("_", " ").lower()

        def scalar(f: Field) -> dict:
            names = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}
            out: dict = {"type": names[f.kind]}
            if f.options:
                out["enum"] = list(OPTIONS[f.options])
            if f.pattern:
                out["pattern"] = PATTERNS[f.pattern]
            if f.email:
                out["format"] = "email"
            if f.lo is not None:
                out["minimum"] = f.lo
            if f.hi is not None:
                out["maximum"] = f.hi
            return out

        def model(name: str) -> dict:
            props = {}
            for f in self.models[name]:
                if f.kind == "object":
                    props[f.name] = optional(f, model(f.model))
                elif f.kind == "list":
                    items = model(f.model) if f.model else {"type": "string"}
                    props[f.name] = {"type": "array", "items": items}
                    if f.min_items:
                        props[f.name]["minItems"] = f.min_items
                    props[f.name] = optional(f, props[f.name])
                else:
                    props[f.name] = optional(f, scalar(f))
            out = {"type": "object", "properties": props}
            required = [f.name for f in self.models[name] if f.required]
            if required:
                out["required"] = required
            if name == "Root" and self.closed_root:
                out["additionalProperties"] = False
            return out

        return json.dumps(model("Root"), separators=(",", ":"))


def _field(text: str, strict_ids: bool) -> Field:
    m = _FIELD.match(text)
    if not m:
        raise ValueError(f"bad field: {text}")
    kind = m["type"] or "str"
    required = bool(m["required"])
    name = m["name"]
    if kind.startswith("{"):
        return Field(name, required, "object", model=kind[1:-1])
    if kind.startswith("["):
        inner = kind[1:-1]
        return Field(
            name, required, "list", model=None if inner == "str" else inner,
            min_items=1 if m["plus"] else None,
        )
    if kind in OPTIONS:
        return Field(name, required, "str", options=kind)
    if kind in PATTERNS:
        pattern = "strict_tax_id" if strict_ids and kind == "tax_id" else kind
        return Field(name, required, "str", pattern=pattern)
    if kind == "email":
        return Field(name, required, "str", email=True)
    lo = m["ge"] or m["lo"]
    return Field(
        name, required, kind,
        lo=None if lo is None else float(lo),
        hi=None if m["hi"] is None else float(m["hi"]),
    )


def record(
    name: str, models: dict[str, str], closed_root: bool = False, strict_ids: bool = False
) -> Record:
    parsed = {k: [_field(t, strict_ids) for t in v.split()] for k, v in models.items()}
    return Record(name, parsed, closed_root)


FORM = record("form", FORM_MODELS, closed_root=True)
VEHICLE = record("vehicle", VEHICLE_MODELS)
