"""Thin Java functions over the JTS library that Spark ships: source in src/, built into quadra-jts.jar."""
