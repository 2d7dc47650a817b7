"""Quillmesh: knowledge-base retrieval and graph analytics on PySpark."""
