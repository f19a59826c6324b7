"""Declared schemas of the source tables, and the model's feature contract."""

from __future__ import annotations

CAT62 = "flightid STRING, lat DOUBLE, lon DOUBLE, flightlevel DOUBLE, speed DOUBLE, dt_radar LONG"
BIMTRA = "flightid STRING, origem STRING, destino STRING, dt_dep LONG, dt_arr LONG"
ESPERAS = "hora LONG, aero STRING, esperas DOUBLE"
METAR = "hora LONG, aero STRING, metar STRING"
METAF = "hora LONG, aero STRING, metaf STRING"
TC_PREV = "hora LONG, aero STRING, troca DOUBLE"
TC_REAL = "hora LONG, aero STRING"
SATELITE = "data STRING, path STRING, tamanho LONG"
TEST_SET = (
    "flightid STRING, origem STRING, destino STRING, hora_ref STRING, dt_dep STRING, path STRING, snapshot_radar STRING, "
    "hora_esperas STRING, esperas DOUBLE, aero_esperas STRING, hora_metar STRING, metar STRING, aero_metar STRING, "
    "hora_metaf STRING, metaf STRING, aero_metaf STRING, hora_tcp STRING, troca DOUBLE, aero_tcp STRING, "
    "hora_tcr STRING, aero_tcr STRING"
)
VERTICES = "data STRING, X INT, Y INT, poly INT, vertice INT"
VERTICES_GEO = "data STRING, poly INT, lat DOUBLE, lon DOUBLE, vertice INT"

# Fixed value: text that stands for an unfinished flight.
OPEN_FLIGHT = "Data final não disponível"

_WEATHER = ["Temperatura", "Ponto de Orvalho", "Velocidade do Vento", "Direção do Vento", "Visibilidade", "Pressão"]

# Names and order of the model's input columns.
FEATURES = [
    "origem", "destino", "linha", "diaSemana", "hora", "esperas",
    "mean_x", "sum_x", "mean_y", "sum_y", "mean", "sum",
    *[f"{w}{s}{side}" for side in ("_x", "_y") for w in _WEATHER for s in ("mean", "min", "max", "std")],
    "troca",
    "dt_radar_lambda", "dt_radar_lambda1", "dt_radar_lambda2", "dt_radar_lambda3",
    "flightlevel_mean", "flightlevel_max", "distancia_",
    "flightlevel_std", "flightlevel_std1", "speed_std", "speed_std1",
    "sum(flight_through_area)",
]
