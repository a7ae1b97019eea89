"""Rule lists of the energy domain. Order, spelling and numbers are part of the data."""

from __future__ import annotations

#: Ordered (pattern, value); patterns ignore case, \b is an ASCII word boundary.
DASHBOARD_TITLE_FUEL = [
    (r"\bLNG\b|liquefi(ed|action)", "lng"),  # does not match "liquefaction"
    (r"solar|photovoltaic|\bPV\b", "solar"),
    (r"offshore wind", "wind_offshore"),
    (r"\bwind\b", "wind_onshore"),
    (r"nuclear|reactor|\bSMR\b", "nuclear"),
    (r"hydro|dam\b", "hydro"),  # matches "Amsterdam"
    (r"geothermal", "geothermal"),
    (r"battery|storage", "storage"),
    (r"pipeline|gas transmission", "pipeline"),
    (r"transmission line|transmission project|\bkV\b", "transmission"),
]
SECTOR_FUEL = {"Pipelines": "pipeline", "Electricity Transmission": "transmission", "Energy Storage": "storage"}
SECTOR_TYPE = {
    "Electricity Transmission": "transmission",
    "Energy Storage": "storage",
    "Pipelines": "pipeline",
    "Conventional Energy Production": "generation",
    "Renewable Energy Production": "generation",
}
LBNL_RESOURCE_FUEL = [
    (r"offshore wind", "wind_offshore"),
    (r"\bwind\b", "wind_onshore"),
    (r"solar", "solar"),
    (r"battery|storage", "storage"),
    (r"\bgas\b", "gas"),
    (r"nuclear", "nuclear"),
    (r"hydro", "hydro"),
    (r"geothermal", "geothermal"),
]
SOURCE_LABEL_KEY = [
    (r"EIA-860M", "eia"),
    (r"Federal Permitting Dashboard", "permittingDashboard"),
    (r"LBNL Queued Up", "lbnl"),
    (r"ORNL HydroSource", "ornlHydro"),
    (r"EIA Natural Gas Pipeline", "eiaPipelines"),
]
EIA_TECHNOLOGY_FUEL = [(r"offshore", "wind_offshore"), (r"battery|storage", "storage")]
EIA_FUEL = {"SUN": "solar", "WND": "wind_onshore", "NG": "gas", "NUC": "nuclear", "WAT": "hydro", "GEO": "geothermal", "MWH": "storage", "BAT": "storage"}
EIA_STAGE = {
    "P": "planned_pre_filing",
    "L": "regulatory_approvals_pending",
    "T": "approved_awaiting_construction",
    "U": "under_construction",
    "V": "under_construction",
    "TS": "completed",
    "OP": "completed",
}
PIPELINE_STAGE = {
    "announced": "planned_pre_filing",
    "proposed": "planned_pre_filing",
    "pre-applied": "agency_permitting",
    "applied": "agency_permitting",
    "on hold": "agency_permitting",
    "approved": "approved_awaiting_construction",
    "construction": "under_construction",
    "part completed": "under_construction",
    "completed": "completed",
    "denied": "cancelled",
    "cancelled": "cancelled",
}
#: Ordered (needles, value) for lower-cased text.
DASHBOARD_STAGE = [(("complete",), "completed"), (("cancel", "withdraw"), "cancelled"), (("construction",), "under_construction")]
LBNL_STAGE = [(("construction",), "under_construction"), (("ia executed",), "approved_awaiting_construction"), (("ia pending",), "approved_awaiting_construction")]
LBNL_CLEARED = ("construction", "ia executed", "ia pending")
ORNL_STAGE = DEFAULT_STAGE = "agency_permitting"
ORNL_WAITING = ("Pending Relicense", "Submitted NOI to Relicense")
RESOLVED_STAGES = ("approved_awaiting_construction", "under_construction", "cancelled", "completed")
ZERO_CARBON = ("solar", "wind_onshore", "wind_offshore", "nuclear", "hydro", "geothermal")
#: 2021 dollars a kW.
COST_PER_KW = {"solar": 1327, "wind_onshore": 1718, "wind_offshore": 6041, "storage": 1316, "gas": 1130, "nuclear": 7030, "hydro": 3083, "geothermal": 3076}
CAPACITY_FLOOR_MW = 250

#: For each field of a source, the headers it may have.
HEADERS = {
    "eia": {
        "entity_id": ["Entity ID"], "plant_id": ["Plant ID"], "plant_name": ["Plant Name"], "state": ["Plant State", "State"], "county": ["County"],
        "generator_id": ["Generator ID"], "capacity": ["Nameplate Capacity (MW)"], "technology": ["Technology"], "energy_code": ["Energy Source Code"],
        "op_month": ["Planned Operation Month"], "op_year": ["Planned Operation Year"], "status": ["Status"], "lat": ["Latitude"], "lon": ["Longitude"],
    },
    "lbnl": {
        "queue_id": ["q_id", "queue_id", "project_id"], "status": ["q_status", "queue_status", "status"],
        "entity": ["entity", "utility", "balancing_authority", "iso_rto"], "state": ["state", "state_poi"], "county": ["county", "county_1"],
        "fips": ["fips_code", "fips", "county_fips"], "resource": ["type_clean", "resource_type", "fuel", "type"],
        "capacity": ["mw_1", "mw1", "capacity_mw", "mw_total"], "storage_capacity": ["mw_2", "mw2", "storage_mw"],
        "queue_date": ["q_date", "queue_date", "date_submitted", "date_entered_queue"], "withdrawn_date": ["wd_date", "withdrawn_date", "date_withdrawn"],
        "ia_date": ["ia_date", "date_ia_executed"], "cod_date": ["on_date", "cod", "cod_date", "estimated_cod"],
        "ia_phase": ["IA_phase_clean", "ia_phase_clean", "ia_phase"], "region": ["region"],
    },
    "ornlHydro": {
        "docket": ["FERC_docket"], "project_name": ["Project_name"], "licensee": ["Project_licensee"], "waterway": ["Waterway"], "project_type": ["Project_type"],
        "lat": ["Latitude"], "lon": ["Longitude"], "state": ["State"], "noi_date": ["NOI_date"], "application_date": ["Application_date"],
        "proc_type": ["Proc_type"], "status": ["Status"], "capacity": ["Capacity_new_MW"],
    },
    "eiaPipelines": {
        "project_name": ["Project Name"], "operator": ["Pipeline Operator Name"], "project_type": ["Project Type"], "status": ["Status"],
        "in_service_year": ["Year In Service Date"], "states": ["State(s)"], "cost_millions": ["Cost (millions)"], "miles": ["Miles"],
        "capacity": ["Additional Capacity (MMcf/d)"], "pipeline_type": ["Pipeline Type"], "authority": ["Authority"], "docket": ["Docket/Permit Number"],
        "demand_served": ["Demand Served"], "website": ["Website"],
    },
}
HEADER_ROW = {"eia": 2, "lbnl": 1, "ornlHydro": 0, "eiaPipelines": 1}
