"""Registered queries and the SQL that they are held against."""

from . import addresses, archives, audio, dsp, jobs, media, pictures, planes, registry, relational, scalars, streams, timing

MODULES = (streams, scalars, registry, timing, audio, pictures, relational, jobs, media, dsp, archives, planes, addresses)
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
