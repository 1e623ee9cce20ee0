"""panelflow.functions"""
