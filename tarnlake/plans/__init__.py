"""Recipes, pipelines and parameter search."""
