"""Constant dimensions as small frames. Codes, labels and centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.presets import COST_PER_KW

PROJECT_TYPES = {"generation": "Generation", "transmission": "Transmission", "storage": "Storage", "lng": "LNG", "pipeline": "Pipeline"}
FUEL_TYPES = {
    "solar": "Solar", "wind_onshore": "Wind (onshore)", "wind_offshore": "Wind (offshore)", "storage": "Storage", "gas": "Gas", "nuclear": "Nuclear",
    "hydro": "Hydro", "lng": "LNG", "pipeline": "Pipeline", "transmission": "Transmission", "geothermal": "Geothermal", "other": "Other",
}
STAGES = {
    "interconnection_study": "Interconnection study",
    "environmental_review": "Environmental review",
    "planned_pre_filing": "Planned, approvals not yet initiated",
    "regulatory_approvals_pending": "Regulatory approvals pending (Category L)",
    "agency_permitting": "Agency permitting",
    "local_review": "Local/state review",
    "litigation": "Litigation",
    "approved_awaiting_construction": "Approved, awaiting construction",
    "under_construction": "Under construction",
    "cancelled": "Cancelled",
    "completed": "Completed",
}
VERIFICATION = {"verified": "Verified (primary source)", "user_submitted_verified": "User-submitted, verified", "user_submitted_pending": "User-submitted, pending review"}
SOURCES = {
    "eia": "EIA-860M", "permittingDashboard": "Federal Permitting Dashboard", "lbnl": "LBNL Queued Up", "ornlHydro": "ORNL HydroSource",
    "eiaPipelines": "EIA Natural Gas Pipelines", "other": "Other",
}
#: slug, label, whether it is the control group.
CAUSES = [
    ("interconnection_queue_backlog", "Interconnection queue backlog", False),
    ("environmental_review_nepa", "Environmental review timeline (NEPA)", False),
    ("multi_agency_permitting", "Multi-agency permitting", False),
    ("transmission_siting_land_rights", "Transmission siting & land rights", False),
    ("litigation_legal_challenge", "Litigation / legal challenge", False),
    ("local_state_opposition", "Local/state opposition", False),
    ("financing_supply_chain_other", "Financing / supply chain / other", True),
]
POLICIES = {
    "interconnection_queue_backlog": "Interconnection process reform",
    "environmental_review_nepa": "NEPA timeline & review reform",
    "multi_agency_permitting": "One Federal Decision",
    "transmission_siting_land_rights": "Federal backstop transmission siting",
    "litigation_legal_challenge": "Judicial review reform",
    "local_state_opposition": "Earlier community engagement",
}
#: code, name, longitude and latitude of the middle (none for Mexico).
STATES = [
    ("AL", "Alabama", -86.9023, 32.3182), ("AK", "Alaska", -152.4044, 64.2008), ("AZ", "Arizona", -111.0937, 34.0489), ("AR", "Arkansas", -92.3731, 34.9697),
    ("CA", "California", -119.4179, 36.7783), ("CO", "Colorado", -105.7821, 39.5501), ("CT", "Connecticut", -72.7554, 41.6032), ("DE", "Delaware", -75.5277, 38.9108),
    ("DC", "District of Columbia", -77.0369, 38.9072), ("FL", "Florida", -81.5158, 27.6648), ("GA", "Georgia", -82.9001, 32.1656), ("HI", "Hawaii", -155.5828, 19.8968),
    ("ID", "Idaho", -114.742, 44.0682), ("IL", "Illinois", -89.3985, 40.6331), ("IN", "Indiana", -86.1349, 40.2672), ("IA", "Iowa", -93.0977, 41.878),
    ("KS", "Kansas", -98.4842, 39.0119), ("KY", "Kentucky", -84.27, 37.8393), ("LA", "Louisiana", -91.9623, 30.9843), ("ME", "Maine", -69.4455, 45.2538),
    ("MD", "Maryland", -76.6413, 39.0458), ("MA", "Massachusetts", -71.3824, 42.4072), ("MI", "Michigan", -84.5361, 44.3148), ("MN", "Minnesota", -94.6859, 46.7296),
    ("MS", "Mississippi", -89.3985, 32.3547), ("MO", "Missouri", -91.8318, 37.9643), ("MT", "Montana", -110.3626, 46.8797), ("NE", "Nebraska", -99.9018, 41.4925),
    ("NV", "Nevada", -116.4194, 38.8026), ("NH", "New Hampshire", -71.5724, 43.1939), ("NJ", "New Jersey", -74.4057, 40.0583), ("NM", "New Mexico", -106.0189, 34.5199),
    ("NY", "New York", -74.9481, 42.9538), ("NC", "North Carolina", -79.0193, 35.7596), ("ND", "North Dakota", -101.002, 47.5515), ("OH", "Ohio", -82.9071, 40.4173),
    ("OK", "Oklahoma", -97.5164, 35.4676), ("OR", "Oregon", -120.5542, 43.8041), ("PA", "Pennsylvania", -77.1945, 41.2033), ("RI", "Rhode Island", -71.4774, 41.5801),
    ("SC", "South Carolina", -81.1637, 33.8361), ("SD", "South Dakota", -99.9018, 43.9695), ("TN", "Tennessee", -86.5804, 35.5175), ("TX", "Texas", -99.9018, 31.9686),
    ("UT", "Utah", -111.0937, 39.321), ("VT", "Vermont", -72.5778, 44.5588), ("VA", "Virginia", -78.6569, 37.4316), ("WA", "Washington", -120.7401, 47.7511),
    ("WV", "West Virginia", -80.4549, 38.5976), ("WI", "Wisconsin", -89.6165, 43.7844), ("WY", "Wyoming", -107.2903, 43.076), ("MX", "Mexico", None, None),
]


def labels(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "value string, label string")


def causes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAUSES, "slug string, label string, is_control_group boolean")


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLICIES.items()), "slug string, title string")


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATES, "value string, label string, lon double, lat double")


def costs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in COST_PER_KW.items()], "fuel_type string, cost_per_kw double")


def centroid_map(points: list[tuple[str, float, float]] | None = None) -> Column:
    """Map from code to struct(lon, lat)."""
    points = [(c, lon, lat) for c, _, lon, lat in STATES if lon is not None] if points is None else points
    return F.create_map(*[x for c, lon, lat in points for x in (F.lit(c), F.struct(F.lit(lon).alias("lon"), F.lit(lat).alias("lat")))])


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    named = {"project_types": PROJECT_TYPES, "fuel_types": FUEL_TYPES, "stages": STAGES, "verification": VERIFICATION, "sources": SOURCES}
    return {k: labels(spark, v) for k, v in named.items()} | {"causes": causes(spark), "policies": policies(spark), "states": states(spark), "costs": costs(spark)}
