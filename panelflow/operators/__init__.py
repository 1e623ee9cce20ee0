"""panelflow.operators"""
