"""Parameters of the corridor engine, with a preset for each published variant."""

from __future__ import annotations

from dataclasses import dataclass, replace

METRES_PER_DEGREE = 111_320.0
EARTH_KM = 6371.0


@dataclass(frozen=True)
class EngineConfig:
    cell_m: float = 90.0
    max_slope: float = 45.0
    water_buffer_m: float = 0.0
    max_elevation: float = 3000.0
    protected_buffer_m: float = 200.0
    max_density: float = 500.0
    weights: tuple[float, ...] = (0.65, 0.15, 0.04, 0.02, 0.02, 0.08, 0.04)  # line, slope, land use, road, rail, water, landslide
    line_decay: float = 2000.0
    water_decay: float = 200.0
    road_decay: float = 2000.0
    rail_decay: float = 3000.0
    slope_reference: float = 28.0
    steep: float = 20.0
    corridor_min: float = 0.02
    corridor_range: float = 1000.0
    diagonal: float = 1.414
    rdp_m: float = 90.0
    spacing_m: float = 30.0
    gate_slope: float = 45.0
    gate_water_m: float = 30.0
    gate_water_share: float = 0.25
    gate_turn: float = 50.0
    gate_sinuosity: float = 3.0
    gate_climb: float = 2500.0
    gate_cost: float = 3.0
    trees: int = 200
    depth: int = 20
    min_leaf: int = 10
    seed: int = 42
    waypoints_per_km: float = 4.0
    corridor_km: float = 30.0
    hard_penalty: float = 100.0
    backward_penalty: float = 10.0
    stall: int = 50
    particles: int = 30
    iterations: int = 200
    beetles: int = 40
    beetle_iterations: int = 300


V2 = EngineConfig()
V1 = replace(V2, max_slope=40.0, water_buffer_m=50.0, max_elevation=3500.0, protected_buffer_m=0.0, weights=(0.60, 0.12, 0.08, 0.04, 0.04, 0.06, 0.06), line_decay=400.0, water_decay=150.0, slope_reference=40.0, steep=25.0, corridor_min=0.3, corridor_range=300.0, diagonal=2**0.5, rdp_m=50.0)
V3 = replace(V2, waypoints_per_km=1.5, corridor_km=15.0, beetles=30, beetle_iterations=200)
V4 = V2
PRESETS = {"v1": V1, "v2": V2, "v3": V3, "v4": V4}

# Words of a tag and their land-use code; the first word that a tag contains wins.
LAND_USE = [
    ("forest", 1), ("wood", 1), ("scrub", 1), ("heath", 1),
    ("farmland", 2), ("farmyard", 2), ("orchard", 2), ("vineyard", 2), ("meadow", 2), ("grass", 2), ("grassland", 2), ("greenfield", 2),
    ("bare_rock", 3), ("bare_ground", 3), ("scree", 3), ("sand", 3), ("beach", 3),
    ("residential", 4), ("retail", 4), ("commercial", 4), ("urban", 4),
    ("industrial", 5), ("quarry", 5), ("brownfield", 5), ("construction", 5),
    ("reservoir", 6), ("basin", 6), ("water", 6), ("salt_pond", 6), ("aquaculture", 6),
    ("wetland", 7), ("marsh", 7), ("swamp", 7), ("mud", 7),
    ("cemetery", 8), ("recreation_ground", 8), ("village_green", 8), ("military", 8), ("allotments", 8), ("plant_nursery", 8),
]
# A land-use code's factor in the soft mask, and its cost in the label.
SOFT_FACTOR = {1: 0.1, 2: 0.3, 3: 0.5, 4: 0.7, 5: 0.8, 6: 0.9, 7: 0.6, 8: 0.2}
LABEL_COST = {1: 0.05, 2: 0.25, 3: 0.15, 4: 0.80, 5: 0.95, 6: 0.90, 7: 0.70, 8: 0.30}
# The bands of the feature stack, in order.
BANDS = [
    "elevation", "slope", "aspect_cos", "aspect_sin", "tri", "tpi", "profile_curvature", "plan_curvature", "roughness",
    "dist_road", "dist_water", "dist_existing_line", "landuse_code", "building_density", "typhoon_risk", "seismic_risk", "landslide_risk", "dist_railway",
]
#: The layer of a grid that a band is taken from, where their names differ.
BAND_LAYERS = {
    "elevation": "z", "profile_curvature": "curvature_profile", "plan_curvature": "curvature_plan", "dist_existing_line": "dist_line", "landuse_code": "landuse",
    "building_density": "density", "typhoon_risk": "typhoon", "seismic_risk": "seismic", "landslide_risk": "landslide", "dist_railway": "dist_rail",
}
