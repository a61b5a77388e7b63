"""panelflow functions"""
