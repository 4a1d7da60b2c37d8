"""Schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

VERTICES = "array<struct<x:double,y:double>>"
EXPOSURES = "ord long, basename string, filter string, detector string, pupil string, stage string, filepath string"
FOOTPRINT = "struct<vertices:array<array<double>>,vertex_marker:array<array<bigint>>,center:array<double>,area:double,radius:double>"
#: A saved box: one JSON document.
BOX = (
    "infos map<string,struct<basename:string,filter:string,detector:string,pupil:string,"
    f"cover_dict:map<string,struct<filepath:string,footprint:{FOOTPRINT}>>>>, proposal_ids array<string>"
)
PRODUCTS = "filename string, dataset string, category string, file_suffix string, access string, instrument_name string, size long"
PIXELS = "image_id string, y long, x long, sci double, err double, dq int"
SPECTRA = "spec_id long, y int, x long, wavelength double, flux double, err double"
WCS = "image_id string, crpix1 double, crpix2 double, crval1 double, crval2 double, cd11 double, cd12 double, cd21 double, cd22 double"
