"""panelflow.sources"""
